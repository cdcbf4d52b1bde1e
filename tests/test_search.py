import random
import re

import pytest

from seamline import fixed
from seamline.operators import search
from tests.test_regex import PIECES

PATTERNS = {
    "wrapper": (fixed.WRAPPER_CALL, (1, 2, 3)), "request": (fixed.REQUEST_CALL, (1, 3, 2)),
    "api_fetch": (fixed.API_FETCH_CALL, (0, 2, 1)), "template_fetch": (fixed.TEMPLATE_FETCH_CALL, (1, 3, 2)),
    "env_constant": (fixed.ENV_CONSTANT, (1, 0, 2)), "env_access": (fixed.ENV_ACCESS, (1, 0, 0)),
    "runtime_config": (fixed.RUNTIME_CONFIG, (1, 0, 0)),
}
CUT = [
    "process.env.", "import.meta.env.", "process", "config.", "config", "useRuntimeConfig()", ".", "Request", ".env.",
    "Request(event,'/x'", ".get(event, '/q'", "1", "_", "a", "apiFetch", "fetch", "event", "(", "'/z'", "A1",
]


@pytest.mark.parametrize("kind", PATTERNS)
def test_same_matches_as_the_whole_pattern_finds(kind):
    pattern, groups = PATTERNS[kind]
    rng, seen = random.Random(kind), 0
    for _ in range(4000):
        text = "".join(rng.choice(PIECES + CUT) for _ in range(rng.randrange(1, 14)))
        expected = [
            (pos, text.count("\n", 0, m.start()) + 1, *[(m[group] or None) if group else None for group in groups])
            for pos, m in enumerate(re.finditer(pattern, text))
        ]
        assert list(search.found_in(text, kind)) == expected, text
        seen += len(expected)
    assert seen > 100


def test_words_and_spaces_are_those_of_unicode():
    assert not list(search.found_in("e\u0301apiFetch('/no')\n\u203fapiFetch('/no')", "api_fetch"))
    assert [m[1] for m in search.found_in("apiFetch\u2003('/a')\napiFetch\u200b('/no')\n\u20acapiFetch('/b')", "api_fetch")] == [1, 3]
    assert not list(search.found_in("apiFetch\x1c('/no')", "api_fetch"))


def test_own_wrapper():
    text = "let B = process.env.X_URL ||\n'https://h/api//?q'\nfetch(`${a.B}${endpoint}`)"
    assert search.definition_in(text) == ("a.B", "/api")
    assert search.definition_in(text.replace("let B", "let C")) == ("a.B", None)
    assert search.definition_in("fetch(`${a.B}/x`)") is None
