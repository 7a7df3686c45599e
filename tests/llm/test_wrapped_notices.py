"""License notices as they stand in files: broken lines, near misses, versions, whole texts."""

import textwrap

from loomline.llm import licenses


def labels_of(spark, rows):
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    return {r["doc_id"]: (r["labels"], r["score"]) for r in found}


def notice(text, mark, width):
    """A notice as it stands in a file's head: broken at a width, a mark before each line, text around it."""
    lines = textwrap.wrap(f"Some words before it. {text}, and so on as the license says.", width)
    return "\n".join(["int x;", "", *[mark + line for line in lines], mark.rstrip(), "int main() { return 0; }"])


def test_wrapped_notices_are_found(spark):
    rows = [(f"{k}/{mark}/{width}", t.label, notice(t.text, mark, width)) for k, t in enumerate(licenses.templates()) for mark in ("", " * ", "# ") for width in (24, 40, 72)]
    labels = labels_of(spark, [r[::2] for r in rows])
    assert [r[0] for r in rows if r[1] not in labels[r[0]][0].split(",") or labels[r[0]][1] != 1.0] == []


def test_each_notice_has_its_own_label(spark):
    """No notice gets another license's label, but a text that holds two of them."""
    rows = [(str(k), t.label, t.text) for k, t in enumerate(licenses.templates())]
    labels = labels_of(spark, [r[::2] for r in rows])
    base = set(licenses.PHRASES.values())
    assert [r for r in rows if set(labels[r[0]][0].split(",")) - base != {r[1]}] == []


def test_near_misses(spark):
    wanted = {
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0",
        "Licensed under CC BY-NC-SA 3.0": "cc-by,cc-by-nc-sa-3.0",
        "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Creative Commons Attribution 4.0 International": "cc-by-4.0",
        "Licensed under the BSD License, Version 2.0": "",
        "The film was released under the license": "",
        "He was released under the licence of 1912 from MIT": "",
        "Licensed under the Apache Licence board, version 2 of 0": "",
        "All members reserved their rights": "",
        "mit license": "",
    }
    labels = labels_of(spark, [(t, t) for t in wanted])
    assert {t: labels[t][0] for t in wanted} == wanted


def test_scattered_tokens_are_no_notice(spark):
    text = next(t.text for t in licenses.templates() if t.label == "isc")
    spread = "\n".join(w + "\nfiller words of a text that is no notice" for w in text.split())
    assert labels_of(spark, [("1", spread)])["1"] == ("", 0.0)
