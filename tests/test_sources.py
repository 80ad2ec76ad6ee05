import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from walkweave.graph import entity_frame
from walkweave.operators.samplers import ObjFreqSampler, SamplerNotSupported
from walkweave.plans.walkers import RandomWalker, WalkerNotSupported, WLWalker
from walkweave.sources import files, ntriples, rdf, sparql

NT = r"""
# a comment
<http://a> <http://p> <http://b> .
<http://a> <http://p> "plain \"quoted\" é\n" .
_:x <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#int> .
<http://a> <http://q> "chat"@fr-BE . # more
<http://a> <http://q> _:x <http://graph> .
<http://a> <http://q> "" .
"""
TRIPLES = [("http://a", "http://p", "http://b"), ("http://a", "http://p", 'plain "quoted" é\n'), ("_:x", "http://p", "5"), ("http://a", "http://q", "chat"), ("http://a", "http://q", "_:x"), ("http://a", "http://q", "")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text(NT)
    assert rows(files.read_triples(spark, str(tmp_path / "x.nt"))) == sorted(TRIPLES)
    ntriples.write(spark.createDataFrame(TRIPLES, "s string, p string, o string"), str(tmp_path / "out"))
    assert rows(ntriples.read(spark, str(tmp_path / "out"))) == sorted(TRIPLES)
    (tmp_path / "bad.nt").write_text("<http://a> <http://p> .\n")
    assert ntriples.read(spark, str(tmp_path / "bad.nt"), strict=False).count() == 0
    with pytest.raises(Exception, match="not a triple"):
        ntriples.read(spark, str(tmp_path / "bad.nt")).collect()


def test_ntriples_take_one_pass_of_the_pattern(spark, tmp_path):
    lines = [
        "<> <http://p> <> .",
        '<http://a> <> "" .',
        '<http://a\u0001b> <http://p> "c\u0001d" .',
        '_:x <http://p> "\u0001"@en <http://g> . # \u0001',
        '<http://a> <http://p> "$1 \\\\ \\u00e9" . # note',
        "  # \u0001",
        "\u0001 # no triple",
        "no triple",
    ]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    found = ntriples.read(spark, str(tmp_path / "x.nt"), strict=False)
    assert rows(found) == sorted([("", "http://p", ""), ("http://a", "", ""), ("http://a\u0001b", "http://p", "c\u0001d"), ("_:x", "http://p", "\u0001"), ("http://a", "http://p", "$1 \\ é")])
    assert "regexp_extract(" not in found._jdf.queryExecution().optimizedPlan().toString()


XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e#" xml:base="http://base/">
  <rdf:Description rdf:about="http://a" e:name="Ann"><e:knows rdf:resource="b"/><e:age rdf:datatype="http://int">5</e:age></rdf:Description>
  <e:Person rdf:ID="c"><e:knows><e:Person rdf:about="http://d"/></e:knows></e:Person>
  <rdf:Description rdf:about="http://l"><e:list rdf:parseType="Collection"><rdf:Description rdf:about="http://i"/></e:list></rdf:Description>
</rdf:RDF>"""


def test_rdf_xml(spark, tmp_path):
    a = rdf.RDF
    found = set(rdf.parse(XML.encode(), "xml"))
    assert {("http://a", "http://e#name", "Ann"), ("http://a", "http://e#knows", "http://base/b"), ("http://a", "http://e#age", "5"), ("http://base/#c", a + "type", "http://e#Person"), ("http://base/#c", "http://e#knows", "http://d"), ("http://d", a + "type", "http://e#Person")} <= found
    assert any(p == a + "first" and o == "http://i" for _, p, o in found) and any(o == a + "nil" for _, _, o in found)
    (tmp_path / "x.owl").write_text(XML)
    assert files.load_graph(spark, str(tmp_path / "x.owl")).triples.count() == len(found)
    spark.dataSource.register(rdf.RdfDataSource)
    assert spark.read.format("rdf").load(str(tmp_path / "x.owl")).count() == len(found)


TURTLE = """@prefix e: <http://e#> . @base <http://base/> .
PREFIX f: <http://f#>
e:a e:knows e:b , <c> ; a f:Person ; e:age 5, 1.5e3, true ; e:says "hi \\"x\\""@en, '''long
text''', "5"^^e:int .
[ e:in e:a ] .
e:l e:list ( e:x "y" ) .
_:n e:p [ e:q _:n ] ; .
"""


def test_turtle():
    found = set(rdf.parse(TURTLE.encode(), "turtle"))
    e = "http://e#"
    assert {(e + "a", e + "knows", e + "b"), (e + "a", e + "knows", "http://base/c"), (e + "a", rdf.RDF + "type", "http://f#Person"), (e + "a", e + "age", "5"), (e + "a", e + "age", "1.5e3"), (e + "a", e + "age", "true"), (e + "a", e + "says", 'hi "x"'), (e + "a", e + "says", "long\ntext"), (e + "a", e + "says", "5")} <= found
    assert len(found) == 9 + 1 + 5 + 2
    for bad in ("e:a e:b e:c .", "<a> <b>", "<a> <b> <c> <d> ."):
        with pytest.raises(ValueError):
            list(rdf.turtle(bad))


def test_json_ld():
    doc = {"@context": {"e": "http://e#", "name": "e:name", "knows": {"@id": "e:knows", "@type": "@id"}}, "@id": "http://a", "@type": "e:Person", "name": ["Ann", 5], "knows": ["http://b", {"@id": "http://c", "name": "Cid"}], "e:list": {"@list": ["x"]}}
    found = set(rdf.parse(json.dumps(doc).encode(), "json-ld"))
    assert {("http://a", rdf.RDF + "type", "http://e#Person"), ("http://a", "http://e#name", "Ann"), ("http://a", "http://e#name", "5"), ("http://a", "http://e#knows", "http://b"), ("http://a", "http://e#knows", "http://c"), ("http://c", "http://e#name", "Cid")} <= found
    assert len(found) == 9


def test_places_and_entities(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_graph(spark, str(tmp_path / "none.nt"))
    with pytest.raises(ValueError):
        files.load_graph(spark, "http://127.0.0.1:9/none")
    with pytest.raises(ValueError):
        rdf.format_of("x.bin")
    (tmp_path / "e.tsv").write_text("bond\tid\tlabel\nhttp://a\t1.0\t0.0\nhttp://b\t2.0\t1.0\n")
    assert [(r.pos, r.entity, r.label) for r in files.read_entities(spark, str(tmp_path / "e.tsv"), "bond").collect()] == [(0, "http://a", "0.0"), (1, "http://b", "1.0")]


def test_query_texts():
    assert sparql.hops_query("e") == "SELECT ?p ?o WHERE { <e> ?p ?o . }"
    assert sparql.hops_query("e", ["p0", "p1"]) == "SELECT ?o WHERE { <e> <p0> ?o1 . ?o1 <p1> ?o . }"
    assert sparql.hops_query("e", ["p0"]) == "SELECT ?o WHERE { <e> <p0> ?o . }"


STORE = [("http://a", "http://p", "http://b"), ("http://b", "http://p", "http://c"), ("http://b", "http://skip", "http://z"), ("http://c", "http://v", "0.5"), ("http://x", "http://p", "http://a")]


class Endpoint(BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_HEAD(self):
        self.send_response(200)
        self.end_headers()

    def do_GET(self):
        query = parse_qs(urlparse(self.path).query)["query"][0]
        self.asked.append(query)
        value = lambda x: {"type": "uri", "value": x}
        names = [x[1:-1] for x in query.split() if x.startswith("<")]
        if query.startswith("ASK"):
            answer = {"boolean": any(s == names[0] for s, _, _ in STORE)}
        else:
            if query.startswith("SELECT ?p ?o"):
                found = [{"p": value(p), "o": value(o)} for s, p, o in STORE if s == names[0]]
            elif query.startswith("SELECT ?s ?p"):
                found = [{"s": value(s), "p": value(p)} for s, p, o in STORE if o == names[0]]
            else:
                at = {names[0]}
                for p in names[1:]:
                    at = {o for s, q, o in STORE if s in at and q == p}
                found = [{"o": value(o)} for o in at]
            answer = {"results": {"bindings": found}}
        body = json.dumps(answer).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_graph(spark, endpoint):
    kg = files.load_graph(spark, endpoint, skip_predicates=["http://skip"], literals=[["http://p", "http://p", "http://v"], ["http://none"]])
    who = entity_frame(spark, ["http://a"])
    assert kg.is_exist(who) and not kg.is_exist(entity_frame(spark, ["http://nobody"]))
    walks = RandomWalker(2, with_reverse=True, md5_bytes=None).extract(kg, who).collect()
    assert [list(r.walk) for r in walks] == [["http://x", "http://p", "http://a", "http://p", "http://b", "http://p", "http://c"]]
    found = {r.chain_idx: (r.kind, [tuple(v) for v in r["values"]]) for r in kg.get_literals(who).collect()}
    assert found == {0: ("scalar", [(0.5, None)]), 1: ("none", [])}
    with pytest.raises(WalkerNotSupported):
        WLWalker(1).extract(kg, who)
    with pytest.raises(SamplerNotSupported):
        RandomWalker(1, 2, ObjFreqSampler()).extract(kg, who)


def test_each_vertex_is_fetched_once(spark, endpoint):
    Endpoint.asked.clear()
    sparql.RemoteGraph(spark, endpoint).around(entity_frame(spark, ["http://a", "http://a"]), 3)
    assert len(Endpoint.asked) == len(set(Endpoint.asked))


def test_stored_answers(spark):
    answer = json.dumps({"results": {"bindings": [{"p": {"value": "p"}, "o": {"value": "o"}}]}})
    assert rows(sparql.hops_of_json(spark.createDataFrame([("v", answer)], "v string, response string"))) == [("v", "p", "o")]


def test_answers_are_kept(endpoint):
    import pickle

    Endpoint.asked.clear()
    connector = sparql.SPARQLConnector(endpoint, kept=1)
    query = sparql.hops_query("http://a")
    assert connector.fetch(query) == connector.fetch(query) and len(Endpoint.asked) == 1
    connector.fetch(sparql.hops_query("http://b"))
    connector.fetch(query)
    assert len(Endpoint.asked) == 3
    pickle.loads(pickle.dumps(connector)).fetch(query)
    sparql.SPARQLConnector(endpoint, kept=0).fetch(query)
    assert len(Endpoint.asked) == 5


def test_long_literals(spark, tmp_path):
    text = 'long \\"text\\" ' * 80_000
    (tmp_path / "long.nt").write_text(f'<http://x.org/a> <http://x.org/p> "{text}"@en .\n<http://x.org/a> <http://x.org/p> "{"x" * 1_000_000}" .\n')
    got = sorted(r.o for r in ntriples.read(spark, str(tmp_path / "long.nt")).collect())
    assert got == sorted([text.replace('\\"', '"'), "x" * 1_000_000])


def test_entities_are_counted(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.tsv").write_text("name\tlabel\n" + "".join(f"e{k}_{i}\t{i}\n" for i in range(40)))
    got = files.read_entities(spark, str(tmp_path), "name").collect()
    assert sorted(r.pos for r in got) == list(range(120)) and {"pos", "entity", "label"} == set(got[0].asDict())
