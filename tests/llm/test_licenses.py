import pytest
from pyspark.sql import functions as F

from gleanery.llm import licenses

FULL = {(name, len(text) > 300): text for name, text in licenses.TEMPLATES}
HOLDS = r"(^|/)(LICENSE|COPYING)[^/]*$"


def wrapped(text, lead="", width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(lead + x for x in [*lines, line])


def scanned(spark, files):
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string"), F.rlike("path", F.lit(HOLDS))).collect()
    return sorted(((r["path"], r["license"], r["origin"], r["from_dir"]) for r in rows), key=str)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nPreamble " + "of the free license " * 3000, "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nPreamble", "GPL-2.0"),
        ("Copyright (c) 2020 Somebody\n\n" + wrapped(FULL["MIT", True]), "MIT"),
        ("Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + wrapped(FULL["BSD-3-Clause", True]), "BSD-3-Clause"),
        ("Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + wrapped(FULL["BSD-2-Clause", True]), "BSD-2-Clause"),
        (wrapped(FULL["ISC", True]), "ISC"),
        ("\n\n" + wrapped(FULL["Unlicense", True]), "Unlicense"),
    ],
)
def test_whole_license_files(spark, text, want):
    rows = scanned(spark, [("a/LICENSE", text), ("a/b/c.py", "x = 1")])
    assert rows == [("a/LICENSE", want, "own", None), ("a/b/c.py", want, "inherited", "a")]


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"])
def test_wrapped_headers(spark, name):
    text = "# Copyright 2020 Somebody\n#\n" + wrapped(max((t for n, t in licenses.TEMPLATES if n == name), key=len), "# ") + "\nimport os\n" + "license = os.sep\n" * 50
    assert scanned(spark, [("a.py", text)]) == [("a.py", name, "own", None)]


def test_odd_rows_ties_and_repeats(spark):
    both = "Released under the MIT License.\nReleased under the ISC License."
    files = [("t/LICENSE-b", "Released under the MIT License."), ("t/LICENSE-a", both), ("t/x", None), ("t/x", None), ("u", ""), (None, both), ("v/y", "license " * 200_000)]
    rows = scanned(spark, files)
    # equal cosine: the smaller name of the license, the smaller path of the file
    assert ("t/LICENSE-a", "ISC", "own", None) in rows and rows.count(("t/x", "ISC", "inherited", "t")) == 2
    assert ("u", None, "none", None) in rows and (None, None, "none", None) in rows and len(rows) == len(files)
    assert scanned(spark, []) == []


def test_a_root_license_reaches_all(spark):
    assert scanned(spark, [("LICENSE", "MIT License"), ("a/b/c", "")]) == [("LICENSE", "MIT", "own", None), ("a/b/c", "MIT", "inherited", "")]


def test_columns_of_any_name_and_templates_of_ones_own(spark):
    df = spark.createDataFrame([("a/LICENSE", "Frobnicate freely under this licence", "x")], "path string, text string, row string").withColumn("license", F.lit(1)).withColumn("notices", F.lit(2))
    (row,) = licenses.scan(df, F.rlike("path", F.lit(HOLDS)), templates=(("Frob", "frobnicate freely under this licence"),)).collect()
    assert (row["license"], row["score"], row["row"], row["notices"]) == ("Frob", 1.0, "x", 2)
