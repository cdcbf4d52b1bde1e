import json

import pytest
from pyspark.sql import functions as F

import seamline as s
from seamline import schema
from seamline.operators import validate
from seamline.plans.staging import numbered
from seamline.sources import contracts, files
from seamline.sources.files import read_source_files
from tests.conftest import rows
from tests.test_impact import DOCUMENTS


def facts_of(spark, *documents):
    return s.documents_to_facts(spark.createDataFrame(list(documents), "repo STRING, document STRING"))


def test_save_replaces_only_the_given_services(spark, tmp_path):
    root = str(tmp_path / "contracts")
    first = facts_of(spark, *DOCUMENTS).drop("repo")
    s.save_contracts(first, root)
    assert rows(s.load_contracts(spark, root), *first.columns) == rows(first, *first.columns)
    smaller = facts_of(spark, ("beta", '{"service": "beta"}')).drop("repo")
    s.save_contracts(smaller, root)
    loaded = s.load_contracts(spark, root)
    assert loaded.filter("service = 'beta'").count() == 1  # the header: nothing stale is left
    assert loaded.filter("service = 'alpha'").count() == first.filter("service = 'alpha'").count()
    assert [r.repo for r in s.discover_repositories(spark, root).collect()] == ["alpha", "beta", "empty"]
    one = s.load_one(spark, root, "alpha")
    assert "PartitionFilters: [isnotnull(repo" in one._jdf.queryExecution().toString()
    assert one.count() == 5


def test_a_write_that_dies_half_way_leaves_the_old_contracts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "contracts")
    first = facts_of(spark, *DOCUMENTS).drop("repo")
    s.save_contracts(first, root)
    old = rows(s.load_contracts(spark, root), *first.columns)

    broken = first.withColumn("line", F.when(F.col("section") == "http_providers", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        s.save_contracts(broken, root)
    assert rows(s.load_contracts(spark, root), *first.columns) == old

    def die(*_):
        raise RuntimeError("killed before the commit")

    with monkeypatch.context() as patched:
        patched.setattr(type(spark.read), "schema", die)
        with pytest.raises(RuntimeError, match="killed"):
            s.save_contracts(first.withColumn("line", F.col("line") + 1), root)
    assert rows(s.load_contracts(spark, root), *first.columns) == old
    s.save_contracts(first.withColumn("line", F.col("line") + 1), root)
    assert rows(s.load_contracts(spark, root), *first.columns) != old
    contracts.drop_old_versions(spark, root)
    assert len(list((tmp_path / "contracts" / "facts").glob("version=*"))) == 1
    assert rows(s.load_contracts(spark, root), "service") == rows(first, "service")


def test_positions_of_a_service_that_lies_in_many_parts(spark):
    facts = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("service"),
        ((F.col("id") * 7919) % 5000).alias("n"),
    )
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = numbered(facts, ["service"], [F.col("n")], "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    by = {}
    for r in sorted(placed, key=lambda r: (r.service, r.n)):
        assert r.place == by.get(r.service, 0)
        by[r.service] = r.place + 1
    assert sum(by.values()) == 5000 and by["hot"] == 4000


def test_last_repository_of_a_service_counts(spark):
    stored = facts_of(
        spark,
        ("a", '{"service": "x", "event_schemas": [{"class_name": "A", "file": "f", "line": 1}]}'),
        ("b", '{"service": "x", "event_schemas": [{"class_name": "B", "file": "f", "line": 1}]}'),
        ("c", '{"service": "y"}'),
    )
    kept = contracts.last_repository(stored).filter("class_name IS NOT NULL")
    assert rows(kept, "service", "class_name") == [("x", "B")]


def test_show_is_in_document_order_with_nulls_kept(spark):
    shown = s.show_contract(facts_of(spark, *DOCUMENTS).drop("repo"), "alpha").collect()
    assert [r.location for r in shown] == [
        "", "provides.http", *["provides.topics_published"] * 3,
    ]
    assert json.loads(shown[0].item) == {"service": "alpha", "extractor_version": "0.1.0"}
    assert list(json.loads(shown[1].item)) == ["method", "path", "handler", "line"]
    assert [json.loads(r.item)["publisher"] for r in shown[2:]] == ["make", "again", "lose"]
    assert json.loads(shown[3].item)["schema"] is None


@pytest.mark.parametrize("items", [1000, 1, 3])
def test_documents_are_written_in_parts_and_read_back(spark, tmp_path, monkeypatch, items):
    monkeypatch.setattr(contracts, "_ITEMS_A_PART", items)
    facts = facts_of(spark, *DOCUMENTS)
    more = facts_of(spark, ("z", json.dumps({
        "service": 'od"d ☃', "consumes": {"topics_subscribed": [{"topic": "t", "handler": None, "line": None}] * 4},
        "_extraction_warnings": [{"kind": "k", "file": "f", "line": 1, "message": 'a "b"'}],
    })))
    facts = facts.unionByName(more).cache()
    for _ in range(2):  # the second time in place of the first
        s.write_documents(facts, str(tmp_path))
    columns = [c for c in facts.columns if c not in ("ord", "repo")]
    assert rows(s.load_documents(spark, str(tmp_path)), *columns) == rows(facts, *columns)
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == ["contracts.json"] * 4
    alpha = json.loads((tmp_path / "alpha" / "contracts.json").read_text())
    assert list(alpha) == ["service", "extractor_version", "provides", "consumes", "event_schemas", "_extraction_warnings"]
    assert [p["publisher"] for p in alpha["provides"]["topics_published"]] == ["make", "again", "lose"]
    assert json.loads((tmp_path / "empty" / "contracts.json").read_text()) == {
        "service": "empty", "extractor_version": "0.1.0", "provides": {"http": [], "topics_published": []},
        "consumes": {"http": [], "topics_subscribed": []}, "event_schemas": [], "_extraction_warnings": [],
    }


def test_read_documents(spark, tmp_path):
    for repo, text in DOCUMENTS:
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "contracts.json").write_text(text)
    assert s.documents_to_facts(s.read_documents(spark, str(tmp_path))).count() == 11


def test_read_source_files(spark, tmp_path):
    texts = {
        "one/app/__init__.py": "x\r\ny\rz\n", "one/app/_private.py": "é", "one/.hidden/a.py": "1",
        "two/a b+c%20.py": "2", "two/skip/a.py": "3", "two/a.ts": "4", "top.py": "5", "one/app/empty.py": "",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    got = read_source_files(spark, str(tmp_path), (".py",), ("skip",))
    assert rows(got, "service", "path", "content") == sorted([
        ("one", "app/__init__.py", "x\ny\nz\n"), ("one", "app/_private.py", "é"),
        ("one", ".hidden/a.py", "1"), ("two", "a b+c%20.py", "2"), ("one", "app/empty.py", ""),
    ], key=repr)


def test_one_service_with_many_directories_is_listed_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"big/app/d{k % 3}/p{k}").mkdir(parents=True)
        (tmp_path / f"big/app/d{k % 3}/p{k}/__init__.py").write_text(str(k))
    (tmp_path / "big/app/d0/again").symlink_to(tmp_path / "big/app", target_is_directory=True)
    tasks = []
    real = files.stage
    monkeypatch.setattr(files, "_DIRS_A_TASK", 30)
    monkeypatch.setattr(files, "stage", lambda df, name, *by: tasks.append((name, df.rdd.getNumPartitions())) or real(df, name, *by))
    listed = files.list_files(spark, files.file_location(spark, str(tmp_path)), (".py",))
    assert listed.count() == 300
    assert tasks == [("source-level", tasks[0][1]), *[("source-level", 1)] * 3, ("source-level", 10)]


def test_a_file_that_cannot_be_read_is_a_warning(spark, tmp_path, env, wrappers):
    for path in ("api/app/a.py", "api/app/gone.py", "api/other/gone.py", "web/src/gone.ts", "web/src/gone.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    location = files.file_location(spark, f"file://{tmp_path}")
    listed = files.list_files(spark, location).cache()
    assert listed.count() == 5
    for path in tmp_path.rglob("gone.*"):
        path.unlink()
    read = files.read_listed(listed, location).cache()
    assert rows(read, "service", "path", "reason") == sorted([
        ("api", "app/a.py", None), ("api", "app/gone.py", "no such file"), ("api", "other/gone.py", "no such file"),
        ("web", "src/gone.ts", "no such file"), ("web", "src/gone.md", "no such file"),
    ], key=repr)
    services = spark.createDataFrame([("web", "frontend")], schema.DIM_SERVICES)
    found = s.extract(read, services, env, wrappers).filter("section = 'extraction_warnings'")
    assert rows(found, "service", "kind", "file", "message") == [
        ("api", "unreadable_file", "app/gone.py", "file could not be read: no such file"),
        ("web", "unreadable_file", "src/gone.ts", "file could not be read: no such file"),
    ]


def test_locations(spark):
    assert files.file_location(spark, "s3a://bucket/repos/") == "s3://bucket/repos"
    assert files.file_location(spark, "file:///a/b") == files.file_location(spark, "/a/b/") == "/a/b"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://names:8020/")
    try:
        assert files.file_location(spark, "/repos") == "hdfs://names:8020/repos"
        assert files.file_location(spark, "file:/repos") == "/repos"
    finally:
        conf.set("fs.defaultFS", before)


def test_calls_are_routed_to_stored_services_that_are_not_extracted_anew(spark, sources, env, wrappers):
    provider = '{"service": "%s", "provides": {"http": [{"method": "GET", "path": "%s", "handler": "h", "line": 1}]}}'
    stored = facts_of(
        spark, ("api", provider % ("api", "/old")), ("far", provider % ("far", "/far/{id}")), ("web", provider % ("web", "/own"))
    ).drop("repo")
    services = spark.createDataFrame([("web", "frontend")], schema.DIM_SERVICES)
    files = sources({
        "api": {"app/a.py": '@router.get("/new")\ndef b(): pass\n'},
        "web": {"src/a.ts": "apiFetch('/new')\napiFetch('/old')\napiFetch('/far/1')\napiFetch('/own')\n"},
    })
    found = lambda *more: rows(
        s.extract(files, services, env, wrappers, *more).filter("section = 'http_consumers'"), "path", "target"
    )
    assert found() == [("/new", "api")]
    assert found(stored) == [("/far/1", "far"), ("/new", "api")]


BROKEN = {
    "{": [("document", None, "not JSON")],
    "[]": [("document", None, "not an object")],
    "{}": [("service", None, "missing")],
    '{"service": null}': [("service", None, "null")],
    '{"service": "s", "extractor_version": 1}': [("extractor_version", None, "not a string")],
    '{"service": "s", "provides": null}': [("provides", None, "not an object")],
    '{"service": "s", "provides": {"http": null}}': [("provides.http", None, "not a list")],
    '{"service": "s", "event_schemas": [1]}': [("event_schemas", 0, "not an object")],
    '{"service": "s", "event_schemas": [{"class_name": 1, "file": "f", "line": 1.5}]}': [
        ("event_schemas.class_name", 0, "not a string"), ("event_schemas.line", 0, "not an integer"),
    ],
    '{"service": "s", "provides": {"http": [{"method": "get", "path": "p", "handler": "h", "line": 1}]}}': [
        ("provides.http.method", 0, "unknown method")
    ],
    '{"service": "s", "provides": {"topics_published": [{"topic": 5, "publisher": "p", "line": "x"}]}}': [
        ("provides.topics_published.line", 0, "not an integer"),
        ("provides.topics_published.topic", 0, "not a string"),
    ],
    '{"service": "s", "consumes": {"topics_subscribed": [{"topic": "t"}, {"topic": "t", "dlq": 1}]}}': [
        ("consumes.topics_subscribed", 1, "unknown field")
    ],
    '{"service": "s", "consumes": {"topics_subscribed": [{"topic": "t", "handler": null, "line": null}]}}': [],
    '{"service": "s", "other": 1, "event_schemas": [{"class_name": "c", "file": "f", "line": "7", "x": 1}]}': [],
    '{"service": "s", "event_schemas": [{"class_name": "c", "file": "f", "line": true}]}': [],
    '{"service": "s", "event_schemas": [{"class_name": "c", "file": "f", "line": 3.0}]}': [],
}


def test_validation(spark):
    raw = spark.createDataFrame(
        [(str(i), text) for i, text in enumerate(BROKEN)], "repo STRING, document STRING"
    ).cache()
    found = {str(i): [] for i in range(len(BROKEN))}
    for r in validate.contract_violations(raw).collect():
        found[r.repo].append((r.location, r.pos, r.rule))
    assert [sorted(v) for v in found.values()] == [sorted(v) for v in BROKEN.values()]
    valid = {r.repo: r.valid for r in validate.contract_validity(raw).collect()}
    assert valid == {k: not v for k, v in found.items()}


def test_lines_are_read_as_validated(spark):
    lines = ['"7"', "3.0", "true", "12", '"2.0"', "3000000000", '" 3000000000"', '"1_000"', "2e3"]
    items = ", ".join('{"class_name": "c", "file": "f", "line": %s}' % line for line in lines)
    facts = facts_of(spark, ("r", '{"service": "s", "event_schemas": [%s]}' % items))
    found = facts.filter("class_name IS NOT NULL").orderBy("ord").collect()
    assert [r.line for r in found] == [7, 3, 1, 12, 2, 3000000000, 3000000000, 1000, 2000]


def test_what_is_no_line_is_reported(spark):
    for line in ('"1__0"', '"x"', "1.5", "1" + "0" * 30, '""', "null"):
        item = '{"class_name": "c", "file": "f", "line": %s}' % line
        text = '{"service": "s", "event_schemas": [%s]}' % item
        raw = spark.createDataFrame([("r", text)], "repo STRING, document STRING")
        assert validate.contract_violations(raw).count() == 1, line
        assert facts_of(spark, ("r", text)).isEmpty()


def test_the_first_name_of_a_schema_counts(spark):
    both = '{"topic": "t", "schema": null, "event_schema": "E", "publisher": "p", "line": 1}'
    odd = '{"topic": "t", "schema": "A", "event_schema": 5, "publisher": "p", "line": 2}'
    one = '{"topic": "t", "event_schema": "E", "publisher": "p", "line": 3}'
    text = '{"service": "s", "provides": {"topics_published": [%s, %s, %s]}}' % (both, odd, one)
    found = facts_of(spark, ("r", text)).filter("topic IS NOT NULL").orderBy("line").collect()
    assert [r.schema for r in found] == [None, "A", "E"]


def test_drift(spark):
    def one(*lines):
        items = ", ".join('{"class_name": "%s", "file": "f", "line": %d}' % i for i in lines)
        return facts_of(spark, ("r", '{"service": "s", "event_schemas": [%s]}' % items)).drop("repo")

    old = one(("Same", 1), ("Moved", 2), ("Gone", 3), ("Twice", 4))
    new = one(("New", 1), ("Twice", 4), ("Twice", 4), ("Moved", 9), ("Same", 1))
    got = s.contract_drift(old, new).collect()
    assert sorted((json.loads(r.fact)["class_name"], r.change, r.removed, r.added) for r in got) == [
        ("Gone", "removed", 1, 0), ("Moved", "changed", 1, 1), ("New", "added", 0, 1), ("Twice", "added", 0, 1),
    ]
    assert s.contract_drift(old, old).isEmpty()


def test_extract_all_kinds(spark, sources, env, wrappers):
    services = spark.createDataFrame([("web", "frontend"), ("api", "backend")], schema.DIM_SERVICES)
    files = sources({
        "api": {"app/a.py": 'router = APIRouter(prefix="/api")\n@router.get("/books/{id}")\ndef b(): pass\n'},
        "web": {"src/a.ts": "apiFetch('/api/books/1')\n", "app/a.py": '@router.get("/no")\ndef b(): pass\n'},
    })
    facts = s.extract(files, services, env, wrappers)
    assert rows(facts.filter("section != 'service'"), "service", "section", "path", "target") == [
        ("api", "http_providers", "/api/books/{id}", None),
        ("web", "http_consumers", "/api/books/1", "api"),
    ]


def test_documents_are_read_and_parsed_once(spark, tmp_path):
    facts = contracts.tagged(spark.sql("SELECT 'a' AS service, 'GET' AS method, '/x' AS path, 'h' AS handler, 1 AS line"), "http_providers")
    contracts.write_documents(facts.unionByName(contracts.header(facts)), f"file:{tmp_path}/docs")
    loaded = contracts.load_documents(spark, f"file:{tmp_path}/docs")
    assert not any("/docs/" in name for name in loaded.inputFiles())  # from the staged facts only
    assert sorted(r.section for r in loaded.collect()) == ["http_providers", "service"]


def test_plain_items_are_told_by_their_type(spark):
    samples = {
        schema.HTTP_PROVIDERS: '{"path": "/a", "method": "GET", "handler": "h", "line": 1}',
        schema.TOPICS_PUBLISHED: '{"topic": "t", "schema": null, "publisher": "p", "line": 2}',
        schema.TOPICS_SUBSCRIBED: '{"topic": "t"}',
        schema.EXTRACTION_WARNINGS: '{"kind": "k", "file": "f", "line": 3, "message": "m"}',
    }
    typed = spark.createDataFrame(list(samples.items()), "section STRING, item STRING").select(
        "section", F.schema_of_variant(F.parse_json("item")).alias("type")
    )
    assert all(row.type in validate.plain_types(row.section) for row in typed.collect())
    lists = {section: [item, item.replace('"GET"', '"get"'), item[:-1] + ', "x": 5}'] for section, item in samples.items()}
    http, topics = ", ".join(lists[schema.HTTP_PROVIDERS]), ", ".join(lists[schema.TOPICS_SUBSCRIBED])
    text = '{"service": "s", "provides": {"http": [%s]}, "consumes": {"topics_subscribed": [%s]}}' % (http, topics)
    found = validate.contract_violations(spark.createDataFrame([("r", text)], "repo STRING, document STRING"))
    assert rows(found, "location", "pos", "rule") == [
        ("consumes.topics_subscribed", 2, "unknown field"), ("provides.http.method", 1, "unknown method"),
    ]


def test_a_document_is_parsed_once_where_it_is_checked(spark):
    raw = spark.createDataFrame([("r", '{"service": "s"}'), ("q", "{")], "repo STRING, document STRING")
    found = contracts.documents_to_facts(raw)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert rows(found, "repo", "service", "section") == [("r", "s", schema.SERVICE)]


def test_documents_are_put_together_by_two_joins_of_the_facts(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(contracts, "small", lambda df: counted.append(df.columns) or df)
    facts = spark.sql("SELECT 'a' AS service, '/x' AS path, 1 AS line UNION ALL SELECT 'b', '/y', 2")
    facts = contracts.tagged(facts, schema.HTTP_PROVIDERS)
    parts = contracts.document_parts(facts.unionByName(contracts.header(facts)))
    assert len(counted) == 1  # besides that of the positions
    texts = {r.repo: json.loads(r.text) for r in parts.collect()}
    assert {k: [i["path"] for i in t["provides"]["http"]] for k, t in texts.items()} == {"a": ["/x"], "b": ["/y"]}
