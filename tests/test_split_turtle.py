"""Turtle by byte ranges gives the rows of the whole-file parser."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkweave.sources import rdf, split_turtle


def document(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = ["@prefix e: <http://e#> .", "# e:a e:b \"\"\" .", "PREFIX f: <http://f#>", ""]
    for i in range(n):
        out.append(
            rng.choice(
                [
                    f"e:s{i} e:p e:o{i} .",
                    f"e:s{i} a f:T ; # a note . with 'quotes\n  e:q 5, 1.5 ;\n\n  e:r <http://x/{i}#y.> .",
                    f'e:s{i} e:t """long\n. e:x e:y e:z .\n@prefix e: <http://no#> .\n"quoted" {i}""" .',
                    f"e:s{i} e:t '''other \"\"\" {i}\n# no comment .\nend'''@en ; e:u \"a # . b\" .",
                    f'e:s{i} e:v "it\'\'\'s", "x\\"y." ;\n  e:w e:o.{i} .',
                    f"e:g{i} {{ e:s{i} e:p e:o . e:s{i} e:p\n e:o2 . }}",
                    f"@prefix f: <http://f{i}#> .",
                    f"<http://long/{i}> e:p\n" + ",\n".join(f"  e:o{j}" for j in range(30)) + " .",
                ]
            )
        )
    return "\n".join(out) + "\n"


@settings(max_examples=300, deadline=None)
@given(seed=st.integers(0, 10**6), cut=st.integers(0, 10**6))
def test_states_hold_wherever_a_file_is_cut(seed, cut):
    text = document(seed, 8)
    lines = text.split("\n")
    state = split_turtle.OUT
    for line in lines:
        state = split_turtle.after(line, state)
    assert state == split_turtle.OUT
    k = cut % (len(lines) + 1)
    first = split_turtle.OUT
    for line in lines[:k]:
        first = split_turtle.after(line, first)
    for line in lines[k:]:
        first = split_turtle.after(line, first)
    assert first == split_turtle.OUT


@pytest.mark.parametrize("size, piece", [(150, 1), (700, 300), (1 << 20, 1 << 18)])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, size, piece):
    texts = {f"f{k}.ttl": document(k, 60) for k in range(3)} | {"empty.ttl": "", "one.ttl": "<http://a> <http://b> <http://c> ."}
    # Declarations that share a line: read whole.
    texts["odd.ttl"] = "@prefix e: <http://e#> . e:a e:b e:c .\n" + "e:x e:y e:z .\n" * 50 + "@prefix\n e: <http://later#> .\ne:a e:b e:c .\n"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = split_turtle.read_turtle(spark, str(tmp_path), piece=piece)
        found = sorted(tuple(r) for r in got.collect())
        if size < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted(t for text in texts.values() for t in rdf.turtle(text))


def test_blank_nodes_stay_apart(spark, tmp_path):
    (tmp_path / "b.ttl").write_text("\n".join(f"_:n{i} <http://p> [ <http://q> {i} ] .\n<http://l> <http://r> ( {i} {i} ) ." for i in range(200)) + "\n_:n1 <http://p> <http://o> .")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = [tuple(r) for r in split_turtle.read_turtle(spark, str(tmp_path), piece=500).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 200 * 7 + 1
    inner = {s for s, p, _ in rows if p == "http://q"}
    assert len(inner) == 200 and {o for _, p, o in rows if p == "http://p"} >= inner
    assert sum(s.startswith("_:n1@") for s, _, _ in rows) == 2
    assert len({s for s, p, _ in rows if p == rdf.RDF + "first"}) == 400


def test_files_of_whole_lines_are_read_without_python(spark, tmp_path):
    """Lines that stand alone give the whole-file parser's rows by Spark's expressions; one other line, and the file goes the long way."""
    lines = [
        "<http://a> <urn:p> <order:1> .",
        '<http://a><urn:p>"x \\"y\\" \\n \\\\ . # é \u0085"@en-GB.# note <http://no> .',
        '  <http://é/b#> <urn:p> "5"^^<http://t#int> .\r',
        '<http://a> <urn:p> "" .',
        "# <http://no> <urn:p> <http://no> .",
        "",
    ]
    others = ["<http://a> <urn:p> <rel> .", "_:b <urn:p> <http://o> .", '<http://a> <urn:p> "\\u00e9" .', '<http://a> <urn:p> "\u0001" .', "<http://a> <urn:p>\n <http://o> .", "@prefix e: <http://e#> .\ne:a e:b 5 .", '<http://a> <urn:p> """ .\n<http://a> <urn:p> <http://o> .\n""" .', "<http://a> <urn:p> <http://o> ; <urn:q> 'x' ."]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.ttl").write_bytes("\n".join(lines).encode())
    got = split_turtle.read_turtle(spark, str(tmp_path / "plain"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rdf.turtle("\n".join(lines)))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    (tmp_path / "both").mkdir()
    texts = ["\n".join([*lines, other]) for other in others] + ["\n".join(lines)]
    for k, text in enumerate(texts):
        (tmp_path / "both" / f"{k}.ttl").write_bytes(text.encode())
    got = split_turtle.read_turtle(spark, str(tmp_path / "both"), base="http://base/")
    plain = lambda rows: sorted(("_:b", *t[1:]) if t[0].startswith("_:b") else t for t in rows)
    assert plain(tuple(r) for r in got.collect()) == plain(t for text in texts for t in rdf.turtle(text, "http://base/"))
