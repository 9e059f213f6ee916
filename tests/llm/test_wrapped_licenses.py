import textwrap

from likeness.llm import license_scan


def test_wrapped_notices_are_found(spark):
    rows = []
    for label, template in license_scan.TEMPLATES:
        for width in (28, 75):
            for head in ("", " * ", "# "):
                body = "\n".join(head + line for line in textwrap.wrap(template.capitalize(), width))
                rows.append((len(rows), label, width, f"int main;\n\n{head}Copyright of someone\n{body}\n{head}\nother text"))
    docs = spark.createDataFrame(rows, "doc_id long, label string, width long, text string").repartition(3)
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert not [(i, label) for i, label, *_ in rows if label not in got[i].labels.split(",")]
    assert all(got[i].score == 1.0 for i, *_ in rows)


def test_templates_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "All rights of the house are kept by the house."), (2, "rights kept")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs, (("house", "all rights of the house are kept"),)).collect()}
    assert got == {1: ("house", 1.0), 2: ("", 0.0)}
