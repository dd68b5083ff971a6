"""Globs with classes, names with wildcards, and coverage that is no whole number."""

import re

from lodestrata.functions.text import glob_regex
from lodestrata.operators import merge, report


def test_glob_classes():
    hit = lambda glob, path: bool(re.match(glob_regex(glob), path))
    assert hit("src/[abc].py", "src/b.py") and not hit("src/[abc].py", "src/d.py") and not hit("src/[!abc].py", "src/a.py") and hit("src/[!abc].py", "src/d.py")
    assert hit("[0-9]*", "x/7y") and not hit("a[!b]c", "a/c") and hit("a[b", "a[b") and hit("a[^]x]", "ay") is hit("a[!]x]", "ay") and hit("[a^]z", "^z")


def test_names_with_wildcards(spark):
    rows = spark.createDataFrame([(1, "load_all"), (2, "loadXall"), (3, "a%b"), (4, "back\\slash")], "id long, name string")
    found = lambda name: [r.id for r in report.by_name(rows, "name", name, "id").collect()]
    assert found("load_all") == [1] and sorted(found("D_A")) == [1, 2] and found("k\\s") == [4] and sorted(found("a%l")) == [1, 2, 4]


def test_coverage_counts_whole_numbers_only(spark):
    texts = ['{"coverage": {"uncovered": %s}}' % v for v in ("5", '"5"', "0", "2.5", "true", "null", "[1]")] + ["{}", "no json", None, '{"coverage": {"uncovered": 3, "skipped": true}}']
    found = merge.run_coverage(spark.createDataFrame(list(enumerate(texts)), "id long, payload string"), "id", "payload").orderBy("id").collect()
    assert [r.not_accounted_for for r in found] == [5, None, 0, *[None] * 8] and [r.id for r in found if r.complete] == [2]
