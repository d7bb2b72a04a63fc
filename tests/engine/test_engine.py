"""Micro-corpora with known answers, properties of retrieval and ranking, sources, streaming and search."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomix.config import IndexConfig
from fathomix.functions import clean, stem
from fathomix.functions.tokens import tokens
from fathomix.operators import dedup, expand, hits, language, present, prior, rank, score
from fathomix.operators import index as index_module
from fathomix.operators.index import by_term, frozen, Index, Stored
from fathomix.plans.query import All, And, Not, Or, Phrase, Query, Range, Term, parse, parse_request, postfix
from fathomix.plans import access
from fathomix.plans.search import Searcher
from fathomix.sources import documents
from fathomix.streaming import ingest

FOUR = IndexConfig(segment_size=4, n_frequent=0)
CORPUS = [(1, "red fox jumps over the lazy red dog"), (2, "red dog sleeps"), (3, "Fox &amp; dog 3d 42"), (4, "lazy fox"), (5, None), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string").withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def index(docs):
    return Index.build(docs, FOUR)


@pytest.fixture(scope="module")
def headed(docs):
    return Index.build(docs.where("doc_id <= 4"), FOUR, {"lang": "lang"}, lang="lang")


def segs(df):
    return {(r.did, r.seg) for r in df.collect()}


def values(df, k, v):
    return {r[k]: round(r[v], 6) for r in df.collect()}


def test_tokens(spark):
    row = spark.createDataFrame([("Fox &amp; 3d 42 ÀÉx9 a" + "b" * 300,)], "t string").select(tokens(F.col("t"))).first()
    assert row[0] == ["fox", "d", "àéx9"]


def test_postings_and_frequencies(index):
    assert index.text_postings.count() == 16
    assert values(index.norm, "term", "freq") == {"d": 1, "dog": 3, "fox": 3, "jumps": 1, "lazy": 2, "over": 1, "red": 3, "sleeps": 1, "the": 1}
    info = index.info.first()
    assert (info.n_docs, info.n_segments, info.n_terms) == (4, 5, 9)
    assert index.decode(index.segments.where("did = 1 and seg = 2")).first().text == "the lazy red dog"


def test_boolean_retrieval(index, headed):
    assert segs(hits.hits(index, Term("red"))) == {(1, 1), (1, 2), (2, 1)}
    assert segs(hits.hits(index, Not(Term("red")))) == {(3, 1), (4, 1)}
    assert segs(hits.hits(headed, Not(Term("red")))) == {(3, 1), (4, 1), (1, 0), (2, 0), (3, 0), (4, 0)}
    assert segs(hits.hits(index, And((Term("fox"), Term("lazy"))))) == {(4, 1)}
    assert segs(hits.hits(headed, And((Term("fox"), Term("lazy"))), by_document=True)) == {(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)}
    assert segs(hits.hits(headed, And((Term("lang:en"), Term("red"))))) == set()
    assert segs(hits.hits(index, Range("lazy", "over"))) == {(1, 1), (1, 2), (4, 1)}
    assert segs(hits.hits(index, And((Term("red"), Not(Term("red")))))) == set()
    assert segs(hits.hits(index, And((Not(Term("red")), Not(Term("lazy")))))) == {(3, 1)}
    assert segs(hits.hits(index, Term("nothing"))) == set()


def test_phrases(index):
    assert segs(hits.phrase(index, ("red", "dog"))) == {(1, 2), (2, 1)}
    assert segs(hits.phrase(index, ("over", "the"))) == {(1, 2)}
    assert segs(hits.phrase(index, ("dog", "red"))) == set() == segs(hits.phrase(index, ()))
    assert segs(hits.phrase(index, ("fox",))) == {(1, 1), (3, 1), (4, 1)}


def test_scores_and_rank(index):
    red = hits.hits(index, Term("red"))
    third = round(1 / 3, 6)
    jaccard = {"red": 1, "dog": 0.5, "jumps": third, "over": third, "the": third, "sleeps": third, "lazy": 0.25, "fox": 0.2}
    assert values(score.scores(index, red), "term", "score") == jaccard
    share = score.normalise(score.counts(index, red), index.norm, None)
    assert values(share, "term", "score") == {"red": 1, "jumps": 1, "over": 1, "the": 1, "sleeps": 1, "dog": 0.666667, "lazy": 0.5, "fox": third}
    dog = hits.hits(index, Term("dog"))
    best = rank.rank(index, dog, score.scores(index, red))
    assert [(r.did, r.score) for r in best.collect()] == [(1, 2.083333), (2, 1.833333), (3, 0.7)]
    top = rank.rank(index, dog, score.scores(index, red), mode="top_segments", top_segments=100)
    assert top.collect() == best.collect()
    priors = index.positions.sparkSession.createDataFrame([(1, 0.5)], "did long, prior double")
    assert values(rank.rank(index, dog, score.scores(index, red), priors), "did", "score") == {1: 1.041667, 2: 1.833333, 3: 0.7}


@pytest.mark.parametrize(("n", "p", "want"), [(13, 1, 1.0), (13, 0, 0.666667), (13, 11, 0.333333), (13, 12, 0.0), (10, 4, 0.0)])
def test_normality(spark, n, p, want):
    text = " ".join("top" if i == p else f"w{chr(97 + i)}" for i in range(n))
    ix = Index.build(spark.createDataFrame([(1, text)], "doc_id long, text string"), IndexConfig())
    got = prior.normality(ix, spark.createDataFrame([("top",)], "term string")).first()
    assert round(got.prior, 6) == want


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [0, 1, 2, 3]), (50, list(range(8))), (51, list(range(10))), (10**6, [5, 6, 7, 8, 9])])
def test_layer_selection(spark, n, want):
    assert score.selected_layers(n) == want
    if n:
        rows = spark.createDataFrame([(i,) for i in range(10)], "layer int").where(score.in_selected_layers(F.lit(n), F.col("layer")))
        assert sorted(r.layer for r in rows.collect()) == want


def test_top_words_at_any_number(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.randint(1, 12))), rng.choice(["en", "de", None])) for i in range(60)]
    ix = Index.build(spark.createDataFrame(rows, "doc_id long, text string, lang string"), FOUR, lang="lang")
    lexicon = ix.lexicon.collect()
    for n in (1, 3, 7, 20, 10_000):
        want = sorted(r.term for lang in ("en", "de", None) for r in sorted((r for r in lexicon if r.lang == lang), key=lambda r: (-r.freq, r.term))[:n])
        assert sorted(r.term for r in prior.top_words(ix, n).collect()) == want


def test_strategy_follows_the_number_of_hits(spark, docs):
    ix = Index.build(docs, IndexConfig(segment_size=4, n_frequent=0, exact_up_to=3, rank_depth=1))
    scored = score.scores(ix, hits.hits(ix, Term("red")))
    few, many = hits.hits(ix, Term("red")), hits.hits(ix, All())
    assert rank.rank(ix, few, scored, mode="auto", depth=9).collect() == rank.rank(ix, few, scored, depth=9).collect()
    assert rank.rank(ix, many, scored, mode="auto", depth=9).collect() == rank.rank(ix, many, scored, mode="top_segments", depth=9).collect()


def test_document_info_and_listing(index):
    assert {(r.did, r.first_seg, r.last_seg, r.n_tokens, r.prior) for r in index.docinfo().where("did <= 2").collect()} >= {(1, 1, 2, 8, 1.0)}
    assert [r.term for r in index.peek("l", 2).collect()] == ["lazy", "over"]


def test_frequent_tokens_rank_nothing(docs):
    ix = Index.build(docs, IndexConfig(segment_size=4, n_frequent=2), lang="lang")
    assert {r.term for r in ix.lexicon.where("is_frequent").collect()} == {"dog", "fox"}
    assert not {"dog", "fox"} & {r.term for r in ix.layered.collect()}


words = st.lists(st.sampled_from("abcdefgh"), max_size=14).map(" ".join)


@given(st.lists(words, min_size=1, max_size=8))
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
def test_properties(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ix, other = Index.build(table.coalesce(1), FOUR), Index.build(table.repartition(5), FOUR)
    every = segs(ix.segments)
    a, b = segs(hits.hits(ix, Term("a"))), segs(hits.hits(ix, Term("b")))
    assert segs(hits.hits(ix, And((Term("a"), Term("b"))))) == a & b
    assert segs(hits.hits(ix, Not(And((Term("a"), Term("b")))))) == every - (a & b) == segs(hits.hits(ix, Or((Not(Term("a")), Not(Term("b"))))))
    assert {d for d, _ in segs(hits.phrase(ix, ("a", "b")))} <= {d for d, _ in a} & {d for d, _ in b}
    rows = score.scores(ix, hits.hits(ix, Term("a"))).collect()
    assert all(0 <= r.score <= 1 and r.cnt <= min(r.freq, len(a)) for r in rows)
    ranked = [rank.rank(x, hits.hits(x, All()), score.scores(x, hits.hits(x, Term("a")))).collect() for x in (ix, other)]
    assert ranked[0] == ranked[1]


def test_query_syntax():
    assert parse("fox") == Query((Term("fox"),), (Term("fox"),))
    assert parse("fox /red") == Query((Term("fox"),), (Term("red"),))
    assert parse('"red dog" /lazy') == Query((Phrase(("red", "dog")),), (Term("lazy"),))
    assert parse('fox /"red dog"').cues == (Phrase(("red", "dog")),)
    assert parse("fox site:example.com").mods == {"site": "example.com"}
    assert parse('"red dog').keys == (Phrase(("red", "dog")),)
    got = parse("fox unknownword", {"fox"})
    assert got.keys == (Term("fox"),) and got.dropped == ("unknownword",)
    assert parse("a b").canonical == parse("b a").canonical
    query, offset = parse_request("q=%22red+dog%22+%2Flazy&offs=20")
    assert query.keys == (Phrase(("red", "dog")),) and offset == 20
    with pytest.raises(ValueError):
        parse_request("nonsense")
    assert postfix(["a", "b", "NOT"]) == Not(And((Term("a"), Term("b")))) and postfix(["b", "NOT", "a"]) == And((Not(Term("b")), Term("a")))
    with pytest.raises(ValueError):
        postfix(["NOT"])


def test_expansion(spark, index):
    table = spark.createDataFrame([("fox", "red"), ("fox", "sleeps")], "term string, expanded string")
    assert segs(hits.hits(index, Term("fox"), expansion=table)) == {(1, 1), (1, 2), (2, 1), (3, 1), (4, 1)}
    assert {r.term for r in expand.expand(spark.createDataFrame([("fox",), ("dog",)], "term string"), table).collect()} == {"fox", "dog", "red", "sleeps"}
    assert expand.merge(table, table).count() == 2 and expand.reverse(table).where("term = 'red'").first().expanded == "fox"
    assert frozen(index.positions, spark.createDataFrame([("fox",)], "term string")).count() == 3
    assert {r.did for r in score.cueset(Index.build(spark.createDataFrame(CORPUS, "doc_id long, text string"), FOUR), ["lazy"]).collect()} == {1, 4}


def test_stemmers():
    pairs = {"consistency": "consist", "hopping": "hop", "hoping": "hope", "happily": "happili", "relational": "relat", "sky": "sky", "dying": "die", "agreed": "agre", "generously": "generous", "knives": "knive"}
    assert {w: stem.english(w) for w in pairs} == pairs
    assert [stem.swedish(w) for w in ("jaktkarlarne", "klokheten", "lösfullt")] == ["jaktkarl", "klok", "lösfull"]
    assert [stem.finnish(w) for w in ("edeltäjien", "edeltävien", "taloissa")] == ["edeltäj", "edeltäv", "talo"]
    assert stem.stem_word("haus", "de") is None


def test_html(spark):
    page = "<!DOCTYPE html><html><head><title>A\nb</title><style>x{}</style></head><body><!-- no --><p>Hi&amp;<b>you</b>   there</p><script>x<y</script>\n\n end 1 < 2</body></html>"
    row = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(clean.normalise_space(clean.expand_entities(clean.strip_html(F.col("h")))).alias("t"), clean.title(F.col("h")).alias("title")).collect()
    assert row[0].t == "Hi& you there\nend 1 < 2" and row[0].title == "A b"
    assert row[1].t is None and row[2].t == ""
    urls = {"http://www.Example.com:80/x?y": "example.com", "https://u:p@a.b.org/#f": "a.b.org", "http://localhost/": None, None: None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", clean.site(F.col("u")).alias("s"), clean.domain(F.col("u")).alias("d"), clean.site_hash(F.col("u")).alias("h")).collect()
    assert {r.u: r.s for r in got} == urls and got[1].d == "b.org" and [r.h == 0 for r in got] == [False, False, True, True]
    kinds = spark.createDataFrame([("abc",), ("é",), ("梦",), ("a\x00",), (None,)], "t string").select(clean.charset_class(F.col("t")).alias("c")).collect()
    assert [r.c for r in kinds] == ["ascii", "latin1", "extended", "unknown", "unknown"]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),), (bytearray("é".encode("utf-16")),)], "b binary")
    assert [r[0] for r in raw.select(clean.decode_bytes(F.col("b"))).collect()] == ["é"] * 3
    sized = spark.createDataFrame([("a" * 9,), ("b",), (None,)], "text string")
    assert clean.limit_size(sized, most=5).count() == 2 and [r.text for r in clean.limit_size(sized, most=5, keep_all=True).collect()] == ["", "b", None]


def test_wire_documents(spark, tmp_path):
    rows = [(1, "http://a.com/x", "T", None, "text/html", [3, 5], "héllo\n---\nrest"), (2, None, None, None, "text/plain", [], "")]
    table = spark.createDataFrame(rows, "key long, url string, title string, date string, mime string, meta array<long>, body string")
    documents.write_wire(table.coalesce(1), str(tmp_path / "w"))
    back = {r.key: r for r in documents.read_wire(spark, str(tmp_path / "w") + "/*.txt").collect()}
    assert back[1].body == "héllo\n---\nrest" and back[1].meta == [3, 5] and back[1].url == "http://a.com/x" and back[2].body == "" and back[1].error is None
    (tmp_path / "bad").write_bytes(b"12\nID 7\n---\nabc\nx1\nID 8")
    (tmp_path / "cut").write_bytes(b"99\nID 9\n---\nabc")
    errors = {r.error for r in documents.read_wire(spark, str(tmp_path / "bad")).unionByName(documents.read_wire(spark, str(tmp_path / "cut"))).collect()}
    assert errors == {None, "bad length", "the file ends in a record"}
    bag = spark.createDataFrame([("5 3 3 0 9",), ("x",), ("",)], "m string").select(documents.meta_bag(F.col("m")).alias("b"))
    assert [r.b for r in bag.collect()] == [[3, 5], [], []]
    more = bag.select(documents.meta_add(F.col("b"), F.lit(4)).alias("a"), documents.meta_first(F.col("b"), 4, 9).alias("f")).collect()
    assert more[0].a == [3, 4, 5] and more[0].f == 5 and more[1].f is None
    documents.write_store(table, str(tmp_path / "s"), with_hashes=True)
    assert [r.key for r in documents.lookup(spark.read.parquet(str(tmp_path / "s")), spark.createDataFrame([(2,), (7,)], "key long")).collect()] == [2]
    assert documents.crawl(table).count() == 1


def test_wiki(spark, tmp_path):
    page = lambda i, t, x: f"<page><title>{t}</title><id>{i}</id><revision><text>{x}</text></revision></page>"
    (tmp_path / "w.xml").write_text("<mediawiki>" + page(1, "A", "alpha") + page(2, "Talk:B", "b") + page(3, "C", "#REDIRECT [[A]]") + page(4, "D", "delta") + "</mediawiki>")
    assert [(r.key, r.title, r.body) for r in documents.read_wiki(spark, str(tmp_path / "w.xml")).orderBy("key").collect()] == [(1, "A", "alpha"), (4, "D", "delta")]


def test_streaming_gives_what_a_batch_gives(spark, docs, index, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp"), FOUR).awaitTermination()
    got = ingest.read(spark, str(tmp_path / "ix"), FOUR)
    assert values(got.norm, "term", "freq") == values(index.norm, "term", "freq")
    assert segs(hits.hits(got, Phrase(("red", "dog")))) == {(1, 2), (2, 1)}
    one = ingest.compact(spark, str(tmp_path / "ix"), str(tmp_path / "one"), FOUR)
    assert values(one.norm, "term", "freq") == values(index.norm, "term", "freq") and segs(hits.hits(one, Phrase(("red", "dog")))) == {(1, 2), (2, 1)}


def test_written_index_answers_the_same(spark, headed, tmp_path):
    headed.write(str(tmp_path / "ix"))
    back = Index.read(spark, str(tmp_path / "ix"))
    assert back.config == FOUR and json.loads(spark.read.text(str(tmp_path / "ix" / "config")).first()[0])["segment_size"] == 4
    for node in (Term("red"), Not(Term("red")), Phrase(("over", "the"))):
        assert segs(hits.hits(back, node)) == segs(hits.hits(headed, node))
    # a lookup of a term in a written index reads some rows of one table, and says so
    read = access.scans(back.inverted("red"))
    assert len(read) == 1 and read[0]["path"].endswith("/inverted") and 0 < read[0]["rows"] and read[0]["bytes"] > 0
    red = [score.scores(x, hits.hits(x, Term("red"))) for x in (headed, back)]
    assert sorted(red[0].collect()) == sorted(red[1].collect())


def test_duplicates_and_sites(spark, index):
    twice = Index.build(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "b a")], "doc_id long, text string"), FOUR)
    assert segs(dedup.one_per_content(twice)) == {(2, 1), (3, 1)}
    sites = spark.createDataFrame([(1, "x.com"), (2, "x.com"), (3, None)], "did long, site string")
    assert segs(dedup.one_per_site(twice.segments.select("did", "seg"), sites)) == {(2, 1), (3, 1)}
    assert segs(dedup.only_site(twice.segments.select("did", "seg"), sites, "X.com")) == {(1, 1), (2, 1)}


def test_language_profiles(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "le chat et le chapeau", "fr"), (3, "", "en"), (4, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.did: r.lang for r in language.classify(table, language.train(table)).collect()}
    assert got == {1: "en", 2: "fr"}
    untagged = table.withColumn("lang", F.when(F.col("doc_id") == 1, "xx"))
    assert {r.doc_id: r.lang for r in language.tag(untagged, language.train(table)).collect()} == {1: "xx", 2: "fr", 3: None, 4: None}
    assert {r.lang for r in language.tag(table.drop("lang"), fixed="fi").collect()} == {"fi"}
    # distances against the definition
    models = {(r.lang, r.gram): r.place for r in language.train(table).collect()}
    mine = [r for r in language.profiles(table, "doc_id").collect() if r.did == 2]
    far = {lang: sum(abs(r.place - models[lang, r.gram]) if (lang, r.gram) in models else language.MISSING for r in mine) for lang in ("en", "fr")}
    assert [r.distance for r in language.classify(table, language.train(table)).collect() if r.did == 2] == [min(far.values())]


def test_search(spark, docs, index):
    body = docs.select(F.col("doc_id").alias("did"), F.concat(F.lit("http://s"), F.col("doc_id"), F.lit(".com/")).alias("url"), F.lit("Title").alias("title"), F.concat(F.lit("\n"), "text", F.lit(".")).alias("body"))
    s = Searcher(index, body.withColumn("site", clean.site(F.col("url"))), keep=2)
    rows = s.search("dog /red").collect()
    # of the two cue segments of site s1 the last one scores; all bands can
    assert [r.did for r in rows] == [1, 2, 3] and "<b>dog</b>" in rows[0].snippet
    want = score.scores(index, hits.hits(index, Term("red")).where("not (did = 1 and seg = 1)"))
    best = rank.rank(index, hits.hits(index, Term("dog")), want)
    assert [(r.did, r.score) for r in rows] == [(r.did, r.score) for r in best.collect()]
    assert [r.did for r in s.search("dog /red", offset=1).collect()] == [2, 3]
    assert [r.did for r in s.search("dog /red site:s2.com").collect()] == [2]
    assert s.search("nosuch").count() == 0 and s.search("red score:").first().term == "dog"
    assert s.total(s.parse("dog")).first().n == 3
    assert len(s._scores) <= 2 and len(s._ranks) <= 2
    s.forget()
    few = Searcher(index, s.docs, priors=spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 1.0)], "did long, prior double"))
    assert {r.did for r in few.search("dog /red").collect()} == {1, 3}


def test_empty_tables(spark):
    ix = Index.build(spark.createDataFrame([], "doc_id long, text string"), FOUR)
    assert hits.hits(ix, Not(Term("a"))).count() == 0
    assert rank.rank(ix, hits.hits(ix, All()), score.scores(ix, hits.hits(ix, Term("a")))).count() == 0
    assert present.snippets(present.sentence_scores(spark.createDataFrame([], "doc_id long, text string"), ["a"], score.scores(ix, hits.hits(ix, Term("a")))), ["a"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_runs_by_term_hold_each_posting_and_place(spark, index, monkeypatch, run):
    monkeypatch.setattr(index_module, "RUN", run)
    posts, places = by_term(index.bags), by_term(index.bags, places=True)
    assert posts.columns == ["did", "seg", "term", "kind"]
    assert sorted(map(tuple, posts.collect())) == sorted(map(tuple, index.postings.collect()))
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, index.places.collect()))
    one = [(r.term, r.did, r.seg) for r in by_term(index.bags.coalesce(1)).collect()] if run == 1000 else []
    assert one == sorted(one)


def test_an_index_is_written_without_a_shuffle_of_its_postings(spark, headed, tmp_path):
    for df in (by_term(headed.bags), by_term(headed.bags, places=True)):
        assert "Exchange" not in plan(df).replace("RoundRobin", "") and "Sort" not in plan(df)
    found = Stored.at(headed, str(tmp_path / "ix"))
    segs(hits.hits(found, And((Phrase(("red", "dog")), Not(Term("sleeps"))))))
    assert not (tmp_path / "ix" / "inverted").exists() and not (tmp_path / "ix" / "places").exists()
    before = segs(hits.hits(found, Or((Term("lang:en"), Phrase(("red", "dog"))))))
    found.write_all()
    assert found.postings.inputFiles()[0].split("/")[-2] == "inverted" and found.places.inputFiles()[0].split("/")[-2] == "places"
    assert segs(hits.hits(found, Or((Term("lang:en"), Phrase(("red", "dog")))))) == before == segs(hits.hits(headed, Or((Term("lang:en"), Phrase(("red", "dog"))))))


def test_the_lexicon_is_counted_before_any_sort_of_postings(headed):
    """The first language of a term needs strings, which only sorting sums; that is done on counts by language."""
    steps = [x.split("- ")[-1] for x in plan(Index.lexicon.func(headed)).splitlines() if "Aggregate" in x]
    assert steps[-1].lstrip("*(0123456789) ").startswith("HashAggregate")


def test_frequencies_with_expansions_are_those_of_the_postings(spark, docs, index):
    one = [("red", "colour"), ("fox", "animal"), ("lazy", "fox")]
    twice = Index.build(docs.unionAll(docs.where("doc_id = 2")), FOUR)
    for ix in (index, twice):
        for pairs in (one, [*one, ("dog", "animal"), ("dog", "animal"), ("none", "thing")]):
            table = spark.createDataFrame(pairs, "term string, expanded string")
            want = expand.add_to_postings(ix.postings, table).groupBy("term").count()
            assert {tuple(r) for r in expand.frequencies(ix, table).collect()} == {tuple(r) for r in want.collect()}
    lone = plan(expand.frequencies(index, spark.createDataFrame(one, "term string, expanded string")))
    assert "did" not in "".join(x for x in lone.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("share", [1e-6, 0.2, 2.0])
def test_sums_of_common_and_rare_terms_are_those_of_one_join(spark, headed, monkeypatch, share):
    monkeypatch.setattr(score, "COMMON", share)
    scored = score.scores(headed, Term("red"))
    rows = headed.postings.select("did", "seg", F.when(F.col("kind") == "token", F.col("term")).alias("term"))
    plain = rows.join(scored.select("term", "score"), "term", "left").groupBy("did", "seg").agg(F.sum(F.coalesce("score", F.lit(0.0))))
    rounded = lambda df: {(r[0], r[1]): round(r[2], 9) for r in df.collect()}
    assert rounded(score.sums(rows, scored, ["did", "seg"])) == rounded(plain)
    assert rounded(score.sums(rows, scored.select("term", "score"), ["did", "seg"])) == rounded(plain)


def test_contents_of_a_query_are_those_of_its_hits(spark, headed):
    red, dog, en, phrase = Term("red"), Term("dog"), Term("lang:en"), Phrase(("lazy", "red"))
    for node in (red, en, All(), Not(red), And((red, Not(dog))), Or((dog, en)), Range("lazy", "over"), phrase, Not(phrase), And((phrase, dog)), Or((phrase, Term("fox"))), Not(And((red, phrase)))):
        want = sorted(map(tuple, headed.contents(hits.hits(headed, node)).collect()))
        assert sorted(map(tuple, headed.contents(node).collect())) == want, node
    plain = Index(headed.bags, FOUR)
    assert "Join" not in plan(plain.contents(And((red, Not(dog)))))
    assert rank.rank(headed, dog, score.scores(headed, red)).collect() == rank.rank(headed, hits.hits(headed, dog), score.scores(headed, hits.hits(headed, red))).collect()


def test_rows_of_tokens_leave_the_text_of_their_sentence(spark):
    docs = spark.createDataFrame([(1, ". one red fox. red red dog."), (2, ". one red fox. nothing."), (3, None)], "doc_id long, text string")
    scored = spark.createDataFrame([("red", 0.5, 3), ("fox", 0.25, 1)], "term string, score double, cnt long")
    found = present.sentence_scores(docs, ["fox"], scored)
    assert not [x for x in plan(found).splitlines() if "Generate explode(t" in x and "sentence" in x]
    # a sentence ends with the full stop that the next one would begin with
    assert sorted(map(tuple, found.collect())) == [(1, 0, ". one red fox.", 1.75), (2, 0, ". one red fox.", 1.75)]


def test_wire_files_are_small_and_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "FILE_RECORDS", 3)
    monkeypatch.setattr(documents, "PIECE", 50)
    docs = spark.createDataFrame([(i, f"http://a/{i}", "t", None, "text/plain", [1, i + 2], "body é " * i) for i in range(10)], "key long, url string, title string, date string, mime string, meta array<long>, body string").coalesce(1)
    documents.write_wire(docs, str(tmp_path / "wire"))
    assert len(list((tmp_path / "wire").glob("*.txt"))) == 4
    back = documents.read_wire(spark, str(tmp_path / "wire" / "*.txt"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect())) and back.where("error is not null").count() == 0


def test_cues_and_hits_of_heads_take_the_heads_alone(headed):
    assert segs(headed.matching(Term("lang:en"))) == {(i, 0) for i in (1, 2, 3, 4)} == segs(hits.hits(headed, Term("lang:en")))
    assert segs(headed.matching(Not(Phrase(("red", "dog"))))) == segs(hits.hits(headed, Not(Phrase(("red", "dog")))))


def test_contamination_makes_nothing_distinct_before_the_items_join(spark):
    from fathomix.plans import catalog

    steps = plan(catalog.queries()["contamination_phrase"](spark, "/root/testdata/sf0.001")).splitlines()
    join = next(i for i, x in enumerate(steps) if "BroadcastHashJoin" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    stream = [x for x in steps[join + 1 :] if depth(x) == depth(steps[join + 1]) or "doc_id" in x]
    assert stream and not [x for x in stream if "HashAggregate" in x or "Exchange hash" in x]
