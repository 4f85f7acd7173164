"""Operators on small tables with values worked out by hand or by a plain second way."""

import collections
import datetime
import itertools
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import analysis, geo, scalar, stemming
from vellum.operators import blockjoin, changes, facets, fuzzy, highlight, ordering, suggest
from vellum.operators.ordering import Key
from vellum.operators.search import AnyOf, Boolean, Constant, DisMax, Fuzzy, Phrase, Prefix, Range, Regexp, Term, TermRange, Wildcard, search, top, words_of
from vellum.plans.postings import Index
from vellum.sources import readers
from vellum.sources.schema import Field, FieldError, Schema
from vellum.streaming import ingest

WORDS = {"text": analysis.whitespace}


@pytest.fixture(scope="module")
def words(spark):
    rows = [(1, "the dog is wagging a tail in the sun"), (2, "a cat sleeps while the dog is out"), (3, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id int, text string").cache()


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_bm25_by_formula(words):
    got = {r.doc_id: r.score for r in search(words, Term("text", "dog"), WORDS).collect()}
    lengths = {1: 9, 2: 8, 4: 0}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    avg = sum(lengths.values()) / 3
    for d in (1, 2):
        assert got[d] == pytest.approx(idf / (1 + 1.2 * (0.25 + 0.75 * lengths[d] / avg)))


def test_boolean_rules(words):
    assert ids(search(words, Boolean(must=[Term("text", "dog")], must_not=[Term("text", "cat")]), WORDS)) == [1]
    assert ids(search(words, Boolean(must_not=[Term("text", "cat")]), WORDS)) == []
    assert ids(search(words, Boolean(should=[Term("text", "cat"), Term("text", "sun")]), WORDS)) == [1, 2]
    assert ids(search(words, Boolean(should=[Term("text", "cat"), Term("text", "dog"), Term("text", "sun")], minimum=2), WORDS)) == [1, 2]
    assert ids(search(words, Boolean(filter=[Term("text", "dog")], should=[Term("text", "sun")]), WORDS)) == [1, 2]
    assert [r.score for r in search(words, Constant(Term("text", "cat"), 10.0), WORDS).collect()] == [10.0]


def test_many_clauses_have_no_join_but_the_statistics(words):
    plan = search(words, Boolean(should=[Term("text", w) for w in "a the dog cat sun is in out".split()]), WORDS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("BroadcastNestedLoopJoin") <= 2


def test_dismax(words):
    both = search(words, DisMax([Term("text", "cat"), Term("text", "dog")], 0.5), WORDS).where("doc_id = 2").first().score
    a = search(words, Term("text", "cat"), WORDS).where("doc_id = 2").first().score
    b = search(words, Term("text", "dog"), WORDS).where("doc_id = 2").first().score
    assert both == pytest.approx(max(a, b) + 0.5 * min(a, b))


@pytest.mark.parametrize(
    "query, want",
    [
        (Phrase("text", ["wagging", "a", "tail"]), [1]),
        (Phrase("text", ["wagging", "tail"]), []),
        (Phrase("text", ["wagging", "tail"], slop=1), [1]),
        (Phrase("text", ["wagging", "tail"], places=[0, 2]), [1]),
        (Phrase("text", [["cat", "dog"], ["is", "sleeps"]]), [1, 2]),
        (Prefix("text", "wag"), [1]),
        (Wildcard("text", "sle?p*"), [2]),
        (Wildcard("text", "s\\*n"), []),
        (Regexp("text", ".*eep.*"), [2]),
        (Regexp("text", "eep"), []),
        (TermRange("text", "su", "t"), [1]),
        (TermRange("text", "sleeps", "sleeps", include_low=False), []),
        (Fuzzy("text", "wging", edits=2), [1]),
        (Fuzzy("text", "wging", edits=1), []),
        (Range("doc_id", 2, None), [2, 3, 4]),
    ],
)
def test_match(words, query, want):
    assert ids(search(words, query, WORDS)) == want


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_damerau_against_plain_recursion(a, b):
    def plain(i, j):
        if min(i, j) == 0:
            return max(i, j)
        best = min(plain(i - 1, j) + 1, plain(i, j - 1) + 1, plain(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, plain(i - 2, j - 2) + 1)
        return best

    assert fuzzy.damerau(a, b, 3) == min(plain(len(a), len(b)), 4)


def test_kept_index_agrees_with_scan(spark, words, tmp_path):
    index = Index.build(words.where("text <> ''"), str(tmp_path / "index"), parts=2, analyzer=analysis.whitespace)
    scan = {r.doc_id: r.score for r in search(words.where("text <> ''"), Boolean(should=[Term("text", "dog"), Term("text", "sun")]), WORDS).collect()}
    assert {r.doc_id: r.score for r in index.search(["dog", "sun"]).collect()} == pytest.approx(scan)
    assert ids(index.containing(index.expand(F.col("term").startswith("s")))) == [1, 2]


def test_facets_against_plain_counting(spark):
    r = random.Random(3)
    rows = [(i, r.choice("xyz"), r.choice("pq"), r.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c int")
    drills = {"a": F.col("a").isin("x", "y"), "b": F.col("b") == "p", "c": F.col("c") == 1}
    tests = {"a": lambda t: t[1] in "xy", "b": lambda t: t[2] == "p", "c": lambda t: t[3] == 1}
    want = {}
    for k, d in enumerate("abc", 1):
        for t in rows:
            if all(f(t) for x, f in tests.items() if x != d) and t[k] is not None:
                want[d, str(t[k])] = want.get((d, str(t[k])), 0) + 1
    assert {(x.dim, x.label): x["count"] for x in facets.drill_sideways(df, drills).collect()} == want
    flat = facets.flat(df, "a", 2).collect()
    assert flat[0].total == 300 and flat[0].child_count == 3 and len(flat) == 2
    assert [x["count"] for x in facets.labels(df, "a", ["z", "nope"]).orderBy("place").collect()] == [sum(t[1] == "z" for t in rows), 0]
    got = facets.ranges(df, F.col("id"), [("low", 0, True, 99, True), ("lower", 0, True, 49, True)]).orderBy("place").collect()
    assert [x["count"] for x in got] == [100, 50]


def test_multi_valued_and_hierarchy(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["b"],), (None,)], "p array<string>")
    assert {x.label: x["count"] for x in facets.multi_valued(df, "p").collect()} == {"a": 1, "b": 2}
    paths = spark.createDataFrame([(["2012", "1"],), (["2012", "2"],), (["2010", "1"],)], "p array<string>")
    assert [(x.label, x["count"]) for x in facets.hierarchy(paths, F.col("p")).collect()] == [("2012", 2), ("2010", 1)]
    assert {x.label for x in facets.hierarchy(paths, F.col("p"), ["2012"]).collect()} == {"1", "2"}


@pytest.mark.parametrize("reverse, last, want", [(False, False, [3, 1, 2]), (True, False, [2, 1, 3]), (False, True, [1, 2, 3]), (True, True, [3, 2, 1])])
def test_missing_values_and_pages(spark, reverse, last, want):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None)], "id int, v double")
    key = Key(F.col("v"), reverse, last)
    assert [r.id for r in ordering.page(df, [key], "id", 10).collect()] == want
    seen, after = [], None
    for _ in range(3):
        page = ordering.page(df, [key], "id", 1) if after is None else ordering.page_after(df, [key], "id", 1, [after.v], after.id)
        after = page.first()
        seen.append(after.id)
    assert seen == want


def test_selectors(spark):
    df = spark.createDataFrame([([3, 1, 2, 2],), ([4, 1],)], "v array<int>")
    got = df.select(*[ordering.selected(F.col("v"), h).alias(h) for h in ("min", "max", "middle_min", "middle_max")]).collect()
    assert [tuple(r) for r in got] == [(1, 3, 2, 2), (1, 4, 1, 4)]


def test_groups(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 9.0), (3, "b", 5.0), (4, None, 1.0), (5, "c", None)], "id int, g string, v double")
    keys = [Key(F.col("v"), reverse=True)]
    got = ordering.top_groups(df, "g", keys, keys, "id", groups=3, hits=1).orderBy("group_rank").collect()
    assert [(r.g, r.id, r.group_hits) for r in got] == [("a", 2, 2), ("b", 3, 1), (None, 4, 1)]


def test_block_join(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    kids = spark.createDataFrame([(1, 1.0, "s"), (1, 3.0, "t"), (2, 2.0, "u")], "pid int, score double, skill string")
    for mode, want in {"max": [3.0, 2.0], "avg": [2.0, 2.0], "total": [4.0, 2.0], "none": [0.0, 0.0]}.items():
        assert [r.score for r in blockjoin.to_parent(parents, kids, "id", "pid", mode).orderBy("id").collect()] == want
    hits = {r.parent: [h.skill for h in r.hits] for r in blockjoin.child_hits(kids, "pid", [F.desc("score")], 1, ["skill"]).collect()}
    assert hits == {1: ["t"], 2: ["u"]}


def test_geo_against_plain_formula(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")

    def metres(a, o, b, p):
        h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
        return 2 * geo.RADIUS * math.asin(min(1, math.sqrt(h)))

    for lat, lon, reach in [(48.0, 2.0, 3e6), (89.0, 10.0, 2e6), (0.0, 179.0, 4e6), (10.0, 10.0, 15e6)]:
        want = sorted(i for i, a, o in rows if metres(a, o, lat, lon) <= reach)
        assert sorted(x.id for x in df.where(geo.within(F.col("lat"), F.col("lon"), lat, lon, reach)).collect()) == want
    square = [(-10.0, -10.0), (-10.0, 50.0), (40.0, 50.0), (40.0, -10.0), (-10.0, -10.0)]
    hole = [(0.0, 0.0), (0.0, 20.0), (20.0, 20.0), (20.0, 0.0), (0.0, 0.0)]
    want = sorted(i for i, a, o in rows if -10 < a < 40 and -10 < o < 50 and not (0 < a < 20 and 0 < o < 20))
    assert sorted(x.id for x in df.where(geo.in_polygon(F.col("lat"), F.col("lon"), square, [hole])).collect()) == want
    assert geo.geojson_rings(json.loads('{"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}')) == [([(2, 1), (4, 3), (2, 1)], [])]


def test_scalar_like_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r.v for r in df.select(scalar.divide(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 1.5
    logs = [r.v for r in df.select(scalar.ln(F.col("a")).alias("v")).collect()]
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_analysis(spark):
    t = F.col("text")
    assert one(spark, analysis.standard(t, analysis.ENGLISH_STOP), "The Dogs and Ünder 3 cats") == ["dogs", "ünder", "3", "cats"]
    assert [(x.position, x.token) for x in one(spark, analysis.with_positions(analysis.standard(t), ["of", "the"]), "box of the dog")] == [(0, "box"), (3, "dog")]
    assert [(x.token, x.start, x.end) for x in one(spark, analysis.with_offsets(t), " é🎉bc, d")] == [("é", 1, 2), ("bc", 3, 5), ("d", 7, 8)]
    assert one(spark, analysis.cjk_bigrams(t), "日本語 ab") == ["日本", "本語", "ab"]
    assert one(spark, analysis.word_delimiter(analysis.whitespace(t)), "PowerShot42 wi-fi") == ["Power", "Shot", "42", "wi", "fi"]
    assert one(spark, analysis.synonyms(analysis.whitespace(t), {"domain name system": "dns", "name": "title"}), "domain name system name") == ["dns", "title"]
    assert one(spark, analysis.synonyms(analysis.whitespace(t), {"a b": "c"}, replace=False), "a b") == ["c", "a", "b"]
    assert one(spark, analysis.ngrams(analysis.whitespace(t), 2, 3), "abc x") == ["ab", "bc", "abc"]
    assert one(spark, analysis.edge_ngrams(analysis.whitespace(t), 1, 2), "abc x") == ["a", "ab", "x"]
    assert one(spark, analysis.shingles(analysis.whitespace(t)), "a b c") == ["a b", "b c"]
    assert one(spark, analysis.shingles(analysis.whitespace(t)), "a") == []
    assert one(spark, analysis.possessive(analysis.whitespace(t)), "dog's cats") == ["dog", "cats"]
    assert one(spark, analysis.minimal_english_stem(analysis.whitespace(t)), "ponies cats glass bus") == ["pony", "cat", "glass", "bus"]
    assert one(spark, analysis.fold_accents(analysis.whitespace(t)), "été niño") == ["ete", "nino"]
    assert one(spark, analysis.pattern(t, ","), "a,,b") == ["a", "b"]
    assert one(spark, analysis.pattern(t, "'([^']+)'", 1), "x 'a b' 'c'") == ["a b", "c"]
    assert one(spark, F.trim(analysis.strip_html(t)), "<p>a&amp;b<script>x<y</script><!-- z --></p>") == "a&b"
    assert one(spark, analysis.joined_values(F.array(t, t)), "a b") == "a b a b"
    stemmed = analysis.map_terms(spark.createDataFrame([("runs",), ("runs",), ("ran",)], "t string"), "t", lambda w: w.rstrip("s"), "stem")
    assert sorted(r.stem for r in stemmed.collect()) == ["ran", "run", "run"]


def test_highlight(spark):
    text = "A dog barks. Nothing here! The dog sees a dog.\nEnd"
    parts = one(spark, highlight.whole(F.col("text"), lambda t: t == "dog"), text)
    assert "".join(p.text for p in parts) == text and [p.text for p in parts if p.hit] == ["dog"] * 3
    found = one(spark, highlight.snippets(F.col("text"), lambda t: t == "dog", most=1), text)
    assert [f.text.strip() for f in found] == ["The dog sees a dog."]
    assert one(spark, highlight.whole(F.col("text"), lambda t: t == "dog"), "") == []
    long = one(spark, highlight.snippets(F.col("text"), lambda t: t == "dog", max_length=20), "dog " * 30)
    assert long[0].text.endswith(" ...")


def test_suggest(spark, tmp_path):
    sep = suggest.SEPARATOR
    path = tmp_path / "s.txt"
    path.write_text(f"# no\n\n5{sep}love lost{sep}p1{sep}c1\n9{sep}love life{sep}p2{sep}c2\n3{sep}the love boat{sep}p3\n")
    entries = suggest.from_file(spark, str(path))
    assert [r.text for r in suggest.by_prefix(entries, "Lov").collect()] == ["love life", "love lost"]
    assert [r.text for r in suggest.by_prefix(entries, "lov", contexts=["c1"]).collect()] == ["love lost"]
    assert [r.text for r in suggest.by_infix(entries, "the lo").collect()] == ["the love boat"]
    assert [r.text for r in suggest.fuzzy(entries, "lvoe", edits=2).collect()] == ["love life", "love lost"]
    changed = suggest.update(entries, entries.where("weight = 3").withColumn("weight", F.lit(99).cast("bigint")))
    assert suggest.by_infix(changed, "lov", 1).first().weight == 99
    parts = one(spark, suggest.highlighted(F.col("text"), "lo bo"), "the love boat")
    assert [(p.hit, p.text) for p in parts] == [(False, "the "), (True, "lo"), (False, "ve "), (True, "bo"), (False, "at")]
    bad = tmp_path / "bad.txt"
    bad.write_text(f"x{sep}a{sep}b\n")
    with pytest.raises(Exception, match="malformed suggestion"):
        suggest.from_file(spark, str(bad)).collect()


def test_changes(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 3, False), (2, None, 4, True)], "k int, v string, seq int, deleted boolean")
    assert [(r.k, r.v) for r in changes.live(log, "k").collect()] == [(1, "b")]
    assert sorted((r.k, r.v) for r in changes.live(log, "k", version=3).collect()) == [(1, "b"), (2, "c")]
    assert changes.delete_by_terms(log, "v", ["a"]).count() == 3
    new = spark.createDataFrame([(1, "z", 9, False)], log.schema)
    assert sorted(r.seq for r in changes.upsert(log, new, "k").collect()) == [3, 4, 9]


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("at", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))])
    csv = tmp_path / "x.csv"
    csv.write_text('id,t,at\n1,"a ""q"", b\nc",1.5;2.5\n2,,\n')
    rows = readers.delimited(spark, str(csv), schema).orderBy("id").collect()
    assert rows[0].t == 'a "q", b\nc' and rows[0]["at"].lon == 2.5 and rows[1].t is None and rows[1]["at"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text("id,nope\n1,2\n")
    with pytest.raises(ValueError, match="header > nope"):
        readers.delimited(spark, str(bad), schema)
    lines = tmp_path / "x.json"
    lines.write_text('{"id": 1, "t": "a"}\n{"id": oops\n')
    assert [r._corrupt is None for r in readers.json_lines(spark, str(lines), schema, strict=False).collect()] == [True, False]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(lines), schema).collect()
    nested = spark.createDataFrame([(1, [(1, "x"), (2, "y")]), (2, [])], "parent_id int, children array<struct<n: int, s: string>>")
    parents, kids = readers.blocks(nested)
    assert parents.count() == 2 and [(r.parent_id, r.place, r.s) for r in kids.orderBy("place").collect()] == [(1, 0, "x"), (1, 1, "y")]
    times = spark.createDataFrame([("2016-11-1",), ("no",)], "d string").select(readers.dates(F.col("d"), "yyyy-MM-dd").alias("v")).collect()
    assert times[0].v == datetime.datetime(2016, 11, 1) and times[1].v is None


def test_schema(spark):
    schema = Schema([Field("price", "float", sort=True), Field("tags", "atom", multi_valued=True), Field("double_price", "virtual", expression="price * 2")])
    rows = spark.createDataFrame([(1.5, ["a"])], schema.struct())
    assert schema.with_virtual(rows).first().double_price == 3.0
    for bad, place in [
        (Field("a b", "text"), "fields > a b"),
        (Field("x_boost", "text"), "x_boost"),
        (Field("x", "text", sort=True), "x > sort"),
        (Field("x", "int"), "used for nothing"),
        (Field("x", "datetime", store=True), "dateTimeFormat"),
        (Field("x", "int", group=True, multi_valued=True), "x > group"),
    ]:
        with pytest.raises(FieldError, match=place):
            Schema([bad])
    with pytest.raises(FieldError, match="already registered"):
        Schema([Field("x", "text"), Field("x", "text")])


def test_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    schema = "id int, kind string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(str(source / "1"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(str(source / "*")), out, state).awaitTermination()
    run()
    run()  # nothing new
    assert sorted(r.id for r in ingest.read(spark, out).collect()) == [1, 2]
    spark.createDataFrame([(3, "a")], schema).write.parquet(str(source / "2"))
    run()
    assert sorted(r.id for r in ingest.read(spark, out).collect()) == [1, 2, 3]
    assert sorted(r.id for r in ingest.read(spark, out, 0).collect()) == [1, 2]


def test_pages_put_together_are_the_whole_order(spark):
    r = random.Random(9)
    rows = [(i, r.choice([None, 1.0, 2.0, 3.0]), r.choice("ab")) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v double, s string").cache()
    keys = [Key(F.col("s"), reverse=True), Key(F.col("v"), missing_last=True)]
    whole = [x.id for x in ordering.page(df, keys, "id", 40).collect()]
    seen, last = [], None
    for _ in itertools.count():
        part = (ordering.page(df, keys, "id", 7) if last is None else ordering.page_after(df, keys, "id", 7, [last.s, last.v], last.id)).collect()
        if not part:
            break
        seen += [x.id for x in part]
        last = part[-1]
    assert seen == whole


def test_top_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0)], "doc_id int, score double")
    assert [r.doc_id for r in top(df, 2).collect()] == [2, 1]


def test_texts_are_analysed_once_a_scan(words):
    """One scan for the rows, one for the statistics, however many clauses."""
    for n in (1, 2, 8):
        plan = search(words.select("*"), Boolean(should=[Term("text", f"w{i}") for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 2
    plan = search(words.select("*"), Phrase("text", ["the", "dog"], slop=1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_words_of_plain_text(words):
    assert ids(search(words, words_of("text", "Dog, -- CAT!"), WORDS)) == [1, 2]
    assert ids(search(words, words_of("text", "dog cat", all_=True), WORDS)) == [2]
    assert ids(search(words, words_of("text", " ... "), WORDS)) == []
    assert ids(search(words, AnyOf("text", ["wagging", "nothing"]), WORDS)) == [1] and ids(search(words, AnyOf("text", []), WORDS)) == []


def test_porter_stems():
    """Examples that the algorithm's paper gives for its steps."""
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
    relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
    analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
    formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
    goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
    replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
    effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
    for word, stem in zip(pairs[::2], pairs[1::2]):
        assert stemming.porter(word) == stem, word
    assert [stemming.porter(x) for x in ("", "is", "é", "2nd", "naïve")] == ["", "is", "é", "2nd", "naïve"]


def test_stems_of_tokens_keep_exclusions(spark):
    df = spark.createDataFrame([("running",), ("skies",), ("news",), (None,), ("running",)], "t string")
    got = sorted(((r.t, r.stem) for r in stemming.english(df, "t", keep=["news"]).collect()), key=str)
    assert got == sorted([("news", "news"), ("running", "run"), ("running", "run"), ("skies", "ski"), (None, None)], key=str)


def test_expansion_over_a_whole_dictionary(spark):
    r = random.Random(3)
    terms = sorted({"".join(r.choice("whité") for _ in range(r.randint(1, 6))) for _ in range(400)})
    got = [(x.term, x.distance) for x in fuzzy.expand(spark.createDataFrame([(t,) for t in terms], "term string"), "whit", 2).collect()]

    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    assert got == sorted(((t, plain(t, "whit")) for t in terms if plain(t, "whit") <= 2), key=lambda x: (x[1], x[0]))[:50]


def test_short_lookups_complete(spark):
    entries = spark.createDataFrame([("alpha", 5), ("album", 9), ("a", 1), ("beta", 3), ("al", 2)], "text string, weight long").withColumn("contexts", F.array(F.lit("x")))
    looked = spark.createDataFrame([("a",), ("al",), ("alp",), ("",), ("bet",)], "typed string")
    got = collections.defaultdict(list)
    for x in suggest.completions(entries, looked, 2).orderBy("typed", "place").collect():
        got[x.typed].append(x.text)
    assert got == {"a": ["album", "alpha"], "al": ["album", "alpha"], "alp": ["alpha"], "bet": ["beta"]}


def test_deleting_all_and_sorted_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, False), (1, "c", 2, False), (3, "d", 2, True)], "k int, v string, seq int, deleted boolean")
    after = rows.unionByName(changes.delete_all(rows, "k"))
    assert changes.live(after, "k").count() == 0 and sorted(r.k for r in changes.live(after, "k", version=2).collect()) == [1, 2]
    changes.write_sorted(spark.range(1000).selectExpr("id", "1000 - id as x"), str(tmp_path / "s"), [F.col("x")], 3)
    spans = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 3 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_offsets_of_long_texts(spark):
    n = 30_000
    df = spark.createDataFrame([("ab é " * n,), (None,), ("",)], "t string")
    got = [r.x for r in df.select(analysis.with_offsets(F.col("t")).alias("x")).collect()]
    assert [len(x) if x is not None else None for x in got] == [2 * n, None, 0] and tuple(got[0][-1]) == ("é", 5 * n - 2, 5 * n - 1)
