"""Personal data replaced by surrogates of the same kind and format.

An entity found in a text is replaced by one made with a keyed hash of its value: the
same value gives the same surrogate in every text, in every spelling, and another value
gives another.  Digits become digits, letters become letters of the same script and case;
a card number keeps its check digit right, an address its ranges.  Each word of a name is
a value of its own, so that people of one surname share its surrogate and differ in their
first names; first names keep the gender of their title, all words their script, and an
initial is the one of the names that it stands for.

Distinct values with equal surrogates, and surrogates that are real values of the corpus,
are found by grouping the table of distinct values; the values that lose are given
another attempt, until none is left.  Only values that needed one travel to the texts,
the rest are made in the task that finds them.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.frames import _quoted, small_enough, text_column
from seamline.plans.staging import stage

QUERY_KEY = "seamline"
# Titles by gender, and the syllables of names by script.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Sig", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ha", "ja", "ka", "le", "lo", "ma", "mi", "na", "ne", "ra", "ri", "sa", "ta", "vi"),
    "cyrillic": ("ба", "ве", "га", "до", "жи", "ка", "ле", "ма", "ни", "по", "ра", "се", "та", "фе", "ша", "ви"),
    "greek": ("βα", "γε", "δα", "ζω", "κα", "λε", "μα", "νι", "πο", "ρα", "σε", "τα", "φι", "χα"),
}
ENDINGS = {
    "latin": {"male": ("n", "s", "r"), "female": ("a", "ina", "ia"), "any": ("l", "x")},
    "cyrillic": {"male": ("н", "р", "й"), "female": ("я", "на", "ия"), "any": ("ль",)},
    "greek": {"male": ("ς", "ος"), "female": ("α", "η"), "any": ("ω",)},
}
# Letters that initials are exchanged among, and words of a name that stay as they are.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
PARTICLES = tuple("van von der den de del della di da dos das do du la le las los el al bin ben ibn ter ten zu zur zum y e af av".split())
_TITLES = "|".join(sorted({re.escape(t) for title in MALE + FEMALE + NEUTRAL for t in (title, title.upper())}, key=len, reverse=True))
_PART = r"[^\W\d_]+(?:['’][^\W\d_]+)*"
_GAP = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"  # one line break at most
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)})\b{_GAP}|d['’])"
# A word needs a capital, which find() looks at: re has no class for it.
_NAME = rf"{_SMALL}*{_PART}\.?(?:[-‐‑]{_PART}\.?)*"
_ADDRESS = r"\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0eff"  # letters, digits and the marks that belong to them
_LABEL = rf"[{_ADDRESS}-]+"
KEY_PREFIX = r"(?:A[KS]IA|(?:sk|pk|rk)[-_](?:live_|test_|proj-|ant-)?|gh[pousr]_|github_pat_|glpat-|hf_|xox[abeoprs]-|AIza|eyJ)"
KINDS = {
    "email": rf"(?<![{_ADDRESS}.+%'’&-])[{_ADDRESS}.+%'’&-]*[{_ADDRESS}+%&-]@{_LABEL}(?:[.。]{_LABEL})*[.。](?:xn--[A-Za-z0-9-]+|[A-Za-z]{{2,}}|(?:(?![A-Za-z0-9_])[{_ADDRESS}]){{2,}})",
    "secret": rf"(?<![A-Za-z0-9])(?:(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?![A-Za-z0-9])|A[KS]IA[0-9A-Z]{{16,}}|{KEY_PREFIX}(?=[\w-]{{0,400}}\d)[\w-]{{16,}}(?:\.[\w-]+)*)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?(?![\w:]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w])\d{4}(?:(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|(?P<wide>[ -])\d{6}(?P=wide)\d{4,5})(?![\w])",
    "phone": (
        r"(?<![\w.+])(?:(?:(?:\+|00 ?)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{2,4}\)|\d{3}(?=[ .-]))(?:[ .-]?\d{2,4}){2,4}"
        r"|0\d(?P<two>[ .-]?)\d{2}(?:(?P=two)\d{2}){3}|(?<!\d:)0\d{1,4}(?:[ /.-]\d{5,8}|(?P<same>[ /-])\d{3,4}(?P=same)\d{3,4})"
        r"|\d{2}[ -]\d{3}[ -]\d{2}[ -]\d{2}|[01]?\d{10})(?![\w])"
    ),
    "name": rf"(?<!\w)(?P<title>(?:{_TITLES})(?:\.\s*|\s+)(?:(?:Dr|DR|Prof|PROF)(?:\.\s*|\s+))*)(?={_NAME})",
}
_WORD = re.compile(_PART)
_ONE = re.compile(f"(?P<small>{_SMALL}*)(?P<rest>{_NAME[len(_SMALL) + 1:]})")
_BETWEEN = re.compile(_GAP)
_STOPS = re.compile(rf"(?!Don\b|DON\b)(?:{_TITLES})\b")
_ANY = re.compile("|".join(f"(?P<{kind}_>{pattern})" for kind, pattern in KINDS.items()))
_DIGIT = re.compile(r"[\d@]")
_TITLE = re.compile(_TITLES)
_HEX = re.compile("[a-f]{8}|[A-F]{8}")  # of 32 letters in a row every fourth


def _may_hold(text: str) -> bool:
    """Whether an entity can be in a text: every kind needs one of these, the cheapest first."""
    return bool(
        _DIGIT.search(text) or "AKIA" in text or "ASIA" in text or "::" in text or text.count(":") > 2
        or _TITLE.search(text) or _HEX.search(text[::4])
    )


def _script(name: str) -> str:
    for c in name:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def _gender(title: str) -> str:
    word = re.match(r"\w+", title)[0].title()
    return "male" if word in MALE else "female" if word in FEMALE else "any"


def _name_end(text: str, start: int) -> int:
    """Where the name that begins at ``start`` ends; ``start`` if none does."""
    end = at = start
    while (one := _ONE.match(text, at)) and one["rest"][0].isupper() and not _STOPS.match(one["rest"]):
        end = one.end()
        if one["rest"].endswith(".") and not re.fullmatch(r"(?:\w\.[-‐‑]?)+", one["rest"]):
            return end - 1  # the end of a sentence
        if not (gap := _BETWEEN.match(text, end)):
            break
        at = gap.end()
    return end


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of every entity of a text, from left to right.

    The value is what stays the same in other spellings: digits of a number, an address
    in lower case, a name's words with the gender of its title (see ``values``).
    """
    if not _may_hold(text):
        return []
    found, at = [], 0
    while m := _ANY.search(text, at):
        at = m.end()
        kind = next(k for k in KINDS if m[f"{k}_"])
        start, end = m.span()
        if kind == "name":
            start, end = m.end(), _name_end(text, m.end())
            if start == end:
                at = end
                continue
            at = end
            value = f"{_gender(m['title'])}|{text[start:end]}"
        elif kind in ("card", "phone", "ssn"):
            value = re.sub(r"\D", "", m.group())
            if not 7 <= len(value) <= 19 or (kind == "phone" and len(value) > 15):
                continue
        elif kind == "ip6":
            try:
                kind, value = "ip", ipaddress.IPv6Address(m.group()).compressed
            except ValueError:
                at = m.start() + m.group().find(":") + 1  # a time, or the like
                continue
            if not re.search("[0-9a-f]", value):
                continue
        elif kind == "secret" and not re.fullmatch("[0-9a-f]+|[0-9A-F]+", m.group()):
            value = m.group()  # a key's case counts
        elif kind == "email":
            start += re.match(r"[.+%'’&-]*", m.group()).end()
            value = text[start:end].lower()
        else:
            value = m.group().lower()
        found.append((start, end, kind, value))
    return _mentioned(text, found)


def _mentioned(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and the places, outside of them, where words of its names stand without a title."""
    known: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind == "name":
            gender, spelled = value.split("|", 1)
            for *_, word in _words(spelled, gender):
                plain = word.rsplit("|", 1)[1]
                if len(plain) > 1 and (plain not in known or known[plain].startswith("any|")):
                    known[plain] = word
    if not known:
        return found
    out, at = [], 0
    for start, end, kind, value in [*found, (len(text), len(text), "", "")]:
        for m in _WORD.finditer(text, at, start):
            spelled = re.sub(r"['’]s$", "", m.group())
            word = known.get(spelled.casefold().replace("’", "'"))
            if word and spelled[0].isupper():
                out.append((m.start(), m.start() + len(spelled), "name", f"{word.split('|')[0]}!|{spelled}"))
        at = end
        if kind:
            out.append((start, end, kind, value))
    return out


def _words(spelled: str, gender: str) -> list[tuple[int, int, str]]:
    """Start, end and value of every word of a name: gender, script and the word.

    The last word, the surname, is the same for every title; in scripts whose surnames
    have a gender it has the title's.  A gender with ``!`` holds for every word.
    """
    spans = [m.span() for m in _WORD.finditer(spelled) if m.group() not in PARTICLES]
    last = max(spelled.rfind(c) for c in " \t\n\r\f\v\xa0") + 1
    out = []
    for start, end in spans:
        if spelled[start:end][:2] in ("d'", "d’"):
            start += 2
        word = spelled[start:end].casefold().replace("’", "'")
        if word.endswith("'s"):
            word, end = word[:-2], end - 2
        script = _script(word)
        of = gender[:-1] if gender.endswith("!") else "any" if start >= last and script == "latin" else gender
        out.append((start, end, f"{of}|{script}|{word}"))
    return out


def values(kind: str, value: str) -> list[str]:
    """The values of an entity that have a surrogate each: of a name every word, apart."""
    if kind != "name":
        return [value]
    gender, spelled = value.split("|", 1)
    return [v for *_, v in _words(spelled, gender) if len(v.rsplit("|", 1)[1]) > 1]


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *about: str):
        self.key, self.about, self.block, self.left = key.encode(), "\x00".join(about), 0, []

    def below(self, n: int) -> int:
        if not self.left:
            data = hmac.new(self.key, f"{self.about}\x00{self.block}".encode(), hashlib.sha256).digest()
            self.left = [int.from_bytes(data[i : i + 4], "big") for i in range(0, 32, 4)]
            self.block += 1
        return self.left.pop() % n


def _check_digit(digits: str) -> str:
    """The last digit that makes a card number right."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 if place % 2 else 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def surrogate(kind: str, value: str, attempt: int, key: str) -> str:
    """The value that stands in for a value; a longer one if many attempts have failed."""
    draw = _Stream(key, kind, value, str(attempt))
    if kind == "name":
        gender, script, word = value.split("|", 2)
        parts = SYLLABLES[script]
        ends = ENDINGS[script][gender]
        name = "".join(parts[draw.below(len(parts))] for _ in range(4 + attempt // 4)) + ends[draw.below(len(ends))]
        return _initial(word[0], script, key) + name[1:]  # so that an initial stands for the same name
    if kind == "ip" and ":" in value:
        return "2001:" + ":".join(f"{draw.below(0xFFFF) + 1:x}" for _ in range(7))
    if kind == "ip":
        return ".".join(str(draw.below(256)) for _ in range(4))
    if kind == "card":
        digits = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        right = _check_digit(value[:-1]) == value[-1]
        return digits + (_check_digit(digits) if right else str(draw.below(10)))
    if kind == "email":
        local, domain = value.split("@")
        name, _, end = domain.replace("。", ".").rpartition(".")
        more = "".join(chr(97 + draw.below(26)) for _ in range(attempt // 4))
        return f"{_letters(local, draw)}{more}@{_letters(name, draw)}.{end}"
    if kind == "phone":
        keep = max(0, len(value) - 10) or int(value[0] == "0")  # the country stays, or the 0 before an area
        return value[:keep] + "".join(str(draw.below(10)) for _ in value[keep:])
    if kind == "secret" and not re.fullmatch("[0-9a-f]+", value):
        kept = re.match(KEY_PREFIX, value).end()
        return value[:kept] + _letters(value[kept:], draw)
    if kind == "secret":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    return "".join(str(draw.below(10)) for _ in value)


@lru_cache(4096)
def _initial(letter: str, script: str, key: str) -> str:
    """Another letter for a letter, no two alike."""
    letters = list(ALPHABETS[script])
    draw = _Stream(key, "initial", script)
    for n in range(len(letters) - 1, 0, -1):
        k = draw.below(n + 1)
        letters[n], letters[k] = letters[k], letters[n]
    plain = unicodedata.normalize("NFKD", letter)[0]
    at = ALPHABETS[script].find(plain)
    return letters[at if at >= 0 else ord(plain) % len(letters)]


def _letters(text: str, draw: _Stream) -> str:
    """Letters for letters, in their case, and digits for digits; other ASCII stays."""
    return "".join(
        str(draw.below(10)) if c.isdigit() else c if c.isascii() and not c.isalpha() else chr((65 if c.isupper() else 97) + draw.below(26))
        for c in text
    )


def render(kind: str, spelled: str, value: str, stands_for: Callable[[str, str], str], key: str) -> str:
    """An entity's surrogate in its spelling; ``stands_for`` gives that of a kind and value."""
    if kind == "name":
        parts, at = [], 0
        for start, end, word in _words(spelled, value.split("|", 1)[0]):
            _, script, plain = word.split("|", 2)
            made = stands_for(kind, word) if len(plain) > 1 else _initial(plain, script, key)
            real = spelled[start:end]
            whole = real.isupper() and (len(real) > 1 or len(made) == 1)
            parts += [spelled[at:start], made.upper() if whole else made.capitalize() if real[0].isupper() else made]
            at = end
        return "".join([*parts, spelled[at:]])
    stands = stands_for(kind, value)
    if kind in ("card", "phone", "ssn"):
        digits = iter(stands)
        return re.sub(r"\d", lambda _: next(digits), spelled)
    return stands.upper() if spelled.isupper() and value.islower() else stands


def _entities(texts: pa.Array) -> dict:
    return {"entities": [[{"kind": k, "value": v} for _, _, k, e in find(t or "") for v in values(k, e)] for t in texts.to_pylist()]}


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, attempt, stands`` of all distinct ``kind, value``, without collisions.

    In each round the values whose surrogate another has, or that is a real value, try
    again; of several values with one surrogate the one settled first keeps it, then the
    least.  A word of a name whose title tells no gender has the surrogate it has under a
    title that does, if there is one.
    """

    def make(attempt_of):
        def run(batches):
            for batch in batches:
                rows = [surrogate(k, v, a, key) for k, v, a in zip(*(c.to_pylist() for c in batch.columns[:3]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.string())], names=["kind", "value", "attempt", "stands"])

        return attempt_of.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, stands string")

    every = stage(entities.select("kind", "value").distinct(), "surrogate-values")
    word = F.regexp_replace("value", r"^\w+\|", "")
    name, open_ = F.col("kind") == "name", F.col("value").startswith("any|")
    told = every.filter(name & ~open_).groupBy(word.alias("word")).agg(F.max("value").alias("as"))
    alike = every.filter(name & open_).select("kind", "value", word.alias("word")).join(told, "word")
    alike = stage(alike.select("kind", "value", "as"), "surrogate-alike")
    taken = every.join(alike, ["kind", "value"], "left_anti")
    settled = stage(make(taken.withColumn("attempt", F.lit(0))), "surrogates")
    spelled = F.when(name, F.substring_index("value", "|", -1)).otherwise(F.col("value"))
    real = every.select("kind", spelled.alias("stands"), F.lit(True).alias("real")).distinct()
    while True:
        first = settled.groupBy("kind", "stands").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = settled.join(first, ["kind", "stands"]).join(real, ["kind", "stands"], "left")
        lost = (F.col("first.value") != F.col("value")) | F.coalesce("real", F.lit(False))
        judged = stage(judged.select("kind", "value", "attempt", "stands", lost.alias("lost")), "surrogates-judged")
        again = judged.filter("lost")
        if again.isEmpty():
            break
        fresh = make(again.withColumn("attempt", F.col("attempt") + 1))
        settled = stage(judged.filter("NOT lost").drop("lost").union(fresh), "surrogates")
    settled = judged.drop("lost")
    given = settled.select("kind", F.col("value").alias("as"), "attempt", "stands")
    joined = alike.join(given, ["kind", "as"]).select("kind", "value", F.greatest("attempt", F.lit(1)).alias("attempt"), "stands")
    return settled.union(joined)


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, the text with surrogates, ``n_entities``, ``kinds``.

    ``kinds`` lists the kinds found, in order, joined by commas.  A null text stays null
    and has none.  Null ids and repeated rows are kept; equal rows get equal texts.  Other
    columns are not read.  An empty table gives an empty result.  Texts move only with
    the surrogates that needed a second attempt, and only if these are too many to send
    to all tasks.
    """
    rows = df.select(
        F.col(_quoted(id_col)).alias("id"), F.col(_quoted(text_col)).cast("string").alias("text")
    ).withColumn("row", F.xxhash64("id", "text"))
    kind = "entities array<struct<kind: string, value: string>>"
    listed = rows.select("row", text_column(_entities, kind)(F.col("text"))["entities"].alias("entities"))
    listed = stage(listed.filter("size(entities) > 0").select("row", F.explode("entities").alias("e")).select("row", "e.*"), "surrogate-entities")
    retried = mapping(listed, key).filter("attempt > 0")
    needed = listed.join(retried, ["kind", "value"]).groupBy("row").agg(
        F.to_json(F.collect_set(F.array("kind", "value", "stands"))).alias("retried")
    )
    needed = stage(needed, "surrogates-retried")
    hint = F.broadcast if small_enough(needed, 1024) else (lambda t: t)
    rows = rows.join(hint(needed), "row", "left")

    def write(pairs: pa.Array) -> dict:
        import json

        out: dict[str, list] = {"text": [], "n_entities": [], "kinds": []}
        for pair in pairs.to_pylist():
            again, _, text = pair.partition("\n")
            other = {(k, v): s for k, v, s in json.loads(again or "[]")}
            parts, at, found = [], 0, find(text)
            for start, end, kind, value in found:
                stands_for = lambda k, v: other.get((k, v)) or surrogate(k, v, 0, key)
                parts += [text[at:start], render(kind, text[start:end], value, stands_for, key)]
                at = end
            out["text"].append("".join([*parts, text[at:]]))
            out["n_entities"].append(len(found))
            out["kinds"].append(",".join(sorted({k for _, _, k, _ in found})))
        return out

    pair = F.concat(F.coalesce("retried", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    made = rows.select("id", "text", text_column(write, "text string, n_entities long, kinds string")(pair).alias("m"))
    return made.select(
        F.col("id").alias(id_col), F.when(F.col("text").isNotNull(), F.col("m.text")).alias("text"), "m.n_entities", "m.kinds"
    )
