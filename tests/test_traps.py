"""What is easily got wrong, case by case, and the messages and fixes of what is found."""

from collections import Counter

import pytest

from tidemark.plans.cases import CASES, TRAPS
from tidemark.plans.check import find, source
from tidemark.rules.base import RULES


def found(spark, key, settings, cases, k="1"):
    check, _, code = key.partition(".")
    put = lambda s: s.replace("{k}", k)
    files = {(put(p), put(text)) for c in cases for p, text in ((c.path, c.source), *c.beside)}
    return find(source(spark.createDataFrame(sorted(files), "path string, content string"), {check: settings}), [RULES[(check, code)]]).collect()


@pytest.mark.parametrize("name", TRAPS)
def test_trap(spark, name):
    key, settings, cases = TRAPS[name]
    got = Counter((r["file"], r["code"], r["severity"], r["line"]) for r in found(spark, key, settings, cases))
    assert got == Counter((c.path.replace("{k}", "1"), *f) for c in cases for f in c.found)


# What a finding says, by rule: parts of its message, and its fix.
SAID = {
    "file_limits.SIZE-003": ("has 11 methods", "Split the class"),
    "security_calls.SHELL-001": ("os.system runs through a shell", "Pass a list of arguments without a shell"),
    "security_calls.EVAL-001": ("eval() of an expression", "Use ast.literal_eval or a table of functions"),
    "docstrings.CMT-006": ("'f' has no docstring", "Say what it is for"),
    "docstrings.CMT-007": ("The docstring of 'load_user' repeats its signature", "Say why, or drop it"),
    "naming_scope.NAMING-005": ("'aa' lives over 21 lines of 'f'", "Give it a name that reads"),
    "prose.PROSE-002": ("'Color' is American spelling", "Write 'colour'"),
    "domain_terms.TERM-NNN": ("Forbidden term 'customer'", "Use 'client'"),
    "forbidden_paths.PATH-001": ("Directory 'legacy' is forbidden", "Move or remove it"),
    "layer_deps.LAYER-001": ("domain/ imports from api/", "Depend inwards only"),
}


@pytest.mark.parametrize("key", SAID)
def test_messages_and_fixes(spark, key):
    message, fix = SAID[key]
    assert any(message in r["message"] and r["fix"] == fix for r in found(spark, key, *CASES[key])), [(r["message"], r["fix"]) for r in found(spark, key, *CASES[key])][:3]
