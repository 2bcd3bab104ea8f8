"""Classifiers, main text, tokenizers and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagesift.llm import toxicity
from pagesift.llm.piece_codec import Codec, decode, encode
from pagesift.llm.quality import N_STATS, keep_good, pool_adjacent, quality_scores, statistics
from pagesift.llm.token_counts import Lookup, count_tokens
from pagesift.llm.wrapper import Template, aligned, extract_main_text, main_text, match
from pagesift.functions.htmltree import parse

ODD = [
    None, "", " ", "  a  b ", "a\nb\t c\r\n", "▁x ▁▁", "ﬁ é é ① ½ ²", "<s> <0x41>\x00z <unk> </s>", "a   b", "​﻿q　w\xa0e\x85", "aaaa" * 500, " " * 300 + "x" + " " * 37,
    "日本語テキスト😀👍🏽", "don't I'll WE'VE <|endoftext|>x<|startoftext|> \x1cy\x1f  z", "İstanbul ΑΣ Σας ß ŒUVRE", "e.g. a,b;c... (x)[y]{z} http://u.v/w?x=1&y#2", "x" * 100_000, "word, " * 20_000, "퟿\U0010ffff",
]
WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sample_texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_token_counts(spark):
    library = Tokenizer.from_file(WORD)
    texts = ODD + sample_texts(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in count_tokens(docs.repartition(3), WORD).collect()}
    for k, t in enumerate(texts):
        assert got[k].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert got[k].n_bytes == len((t or "").encode())
    assert count_tokens(docs.limit(0), WORD).count() == 0


def test_counts_do_not_depend_on_the_table():
    texts = ["some words, some more", "some"]
    plain = Lookup(WORD, {}).count(texts)
    assert plain == Lookup(WORD, {"some": 1}).count(texts) == Lookup(WORD, {"": 0}).count(texts)


def test_codec(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ODD + sample_texts(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in encode(docs.repartition(3), PIECE).collect()}
    short = {r.doc_id: r for r in encode(docs, PIECE, digests=True).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k]["ids"] == ids, t
        assert got[k].decoded == library.decode(ids)
        assert tuple(short[k])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    back = decode(encode(docs, PIECE), PIECE).collect()
    assert {r.doc_id: r.text for r in back} == {k: library.decode(library.encode(t or "")) for k, t in enumerate(texts)}


def test_codec_on_random_texts_and_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), Codec(PIECE)
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(" aeiosrtnth.,-▁é'\n") for _ in range(r.randrange(40)))
        ids = library.encode(t)
        assert own.model.encode_text(t) == ids and own.run(t)[1] == ",".join(map(str, ids)), t
        ids = [r.randrange(3, 32_000) for _ in range(6)]
        assert own.model.decode(ids) == library.decode(ids), ids


def test_full_caches_change_no_result(spark, monkeypatch):
    from pagesift.llm import piece_codec

    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECE), sample_texts(spark)
    monkeypatch.setattr(piece_codec, "CACHE_SIZE", 50)
    monkeypatch.setattr(piece_codec, "PAIRS_SIZE", 20)
    own = Codec(PIECE)
    assert all(own.run(t)[1] == ",".join(map(str, library.encode(t))) for t in texts if t)
    assert len(own.cache) <= 50 and len(own.older) <= 50 and len(own.model.pairs) <= 20


PAGE = """<html><head><title>t</title><script>var a="<article>";</script></head><body><header>site</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">accept</div><article><h1>Head &amp; line</h1><p>one <b>two</b>three<br>four<p>five&nbsp;
 six<div class="ad">buy</div><form>name</form><aside>side</aside><section id="comments"><p>reader</section>{}</article><footer>foot</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE.format("<p>end")) == "Head & line one twothree four five six end"
    assert main_text("<body><div class=sidebar>s</div><main><p>a</p>b<style>x</style></main>") == "a b"
    assert main_text(f"<div class=menu>m</div><div><p>{'long ' * 30}</div><div class=footer>f</div>") == ("long " * 30).strip()
    assert [main_text(x) for x in (None, "", "   ", "<p", "<!-- x", "plain text")] == ["", "", "", "<p", "", "plain text"]
    assert main_text("<article>a<article class='comment'>c</article></article><article class='comment'>d</article>") == "a"


def test_tree_matching():
    a, b = parse("<div><p>x<p>y</div><ul><li>1</ul>"), parse("<h1>t</h1><div><p>z</div><ul><li>2<li>3</ul>")
    skeleton = Template.induce(a)
    assert match(Template.load(skeleton), a) == 5 == match(Template.load(skeleton), b)
    found = aligned(skeleton, b)
    assert sorted(e.tag for es in found.values() for e in es) == ["div", "li", "li", "p", "ul"]


def test_wrappers_drop_what_all_pages_say(spark):
    """A line that every page of a host has in its article is template; what varies is kept."""
    page = lambda k: f"<article><h1>Title {k}</h1><div class=tagline>Read more every day</div><p>Body {k}</p></article>"
    rows = [(k, f"http://h{k % 2}.x/{k}", page(k)) for k in range(40)] + [(100, None, page(100)), (101, "u", None), (102, "http://h0.x/z", ""), (103, "http://solo.x/", page(103))]
    rows += [(200 + k, "http://copies.x/", page(7)) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[k] == f"Title {k} Body {k}" for k in range(40))
    assert got[100] == "Title 100 Read more every day Body 100" and got[103].startswith("Title 103 Read")
    assert got[101] == got[102] == "" and got[203] == "Title 7 Read more every day Body 7"
    assert extract_main_text(pages.limit(0)).count() == 0


def test_copies_and_optional_places_are_no_template(spark):
    """What only copies of a page, or a few pages of a host, have in their article is kept."""
    first = "<article><h1>Head</h1><p>one</p><h2>Second</h2><p>two</p><blockquote>said</blockquote></article>"
    rows = [(k, "http://a.x/", first) for k in range(6)]
    rows += [(10 + k, "http://a.x/", f"<article><h1>Other {k}</h1><p>text {k}</p></article>") for k in range(9)]
    page = lambda k: f"<article><h1>Title {k}</h1>{'<h2>Summary</h2>' if k < 6 else ''}<div class=tagline>Always</div><p>Body {k}</p></article>"
    rows += [(100 + k, "http://b.x/", page(k)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(4)).collect()}
    assert all(got[k] == "Head one Second two said" for k in range(6))
    assert all(got[10 + k] == f"Other {k} text {k}" for k in range(9))
    assert all(got[100 + k] == f"Title {k} {'Summary ' if k < 6 else ''}Body {k}" for k in range(40))


def test_content_is_found_without_telling_names(spark):
    """The article is a plain part among constant parts of the same label, beside a menu and a list of links."""
    part = "<div><p>Welcome to our site</p><p>We are open daily</p></div>"
    page = lambda k: f"<body>{part}<div><div><a href='/{k}'>Link {k}</a> <a href='/x'>more {k}</a></div></div><div><h2>Title {k}</h2><div><p>Body {k} one</p><p>and {k} two</p></div></div><div><p>All rights reserved</p></div></body>"
    rows = [(k, "http://plain.x/", page(k)) for k in range(30)] + [(100, "http://small.x/", "<body><div>menu</div><main><p>own</p></main></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(4)).collect()}
    assert all(got[k] == f"Title {k} Body {k} one and {k} two" for k in range(30))
    assert got[100] == "own"


@pytest.mark.parametrize("rows", [20_000, 0])
def test_wrappers_that_are_not_broadcast(spark, monkeypatch, rows):
    from pagesift.llm import wrapper

    monkeypatch.setattr(wrapper, "BROADCAST_HOSTS", rows)
    pages = spark.createDataFrame([(k, f"http://h{k % 3 if k < 300 else k}.x/", f"<article><p>Always</p><h1>T {k}</h1></article>") for k in range(320)] + [(999, "http://null.x/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages.repartition(4)).collect()}
    assert len(got) == 321 and all(got[k] == (f"T {k}" if k < 300 else f"Always T {k}") for k in range(320)) and got[999] == ""


def labelled(spark, n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "at", "es"]) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(r.randrange(30, 200))]
        bad, toxic = k % 5 == 0, k % 7 == 0
        if bad:
            words = [w + "&&&" for w in words] if k % 2 else words[:3] * 30
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["scumbagly", "idiotron", "trashic"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(9000, None), (9001, ""), (9002, "x" * 200_000), (None, "th er"), (9003, "a\u0000b")]
    labels += [(9001, None, None), (77_777, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("stats", F.lit("clash")).withColumn("y", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(rows, folds, fold):
    return [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % folds == fold]


def test_quality(spark):
    docs, labels = labelled(spark)
    rows = quality_scores(docs, labels).collect()
    test = held(rows, 3, 1)
    assert len(rows) == docs.count() and len(test) > 200
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in test]) > 0.97
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    lied = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, lied))
    assert a == pytest.approx(b)


def test_quality_is_the_plain_ridge_solution(spark):
    """Sums over partitions give what one system over all rows gives, null and doubled labels aside."""
    from pagesift.llm import quality

    docs, labels = labelled(spark, 400)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    labels = labels.union(labels.where("doc_id < 50")).union(labels.limit(30).withColumn("quality", F.lit(None).cast("int")))
    seen, plain = [], quality.fit
    stats = {r.doc_id: statistics(r.text) for r in docs.collect()}
    rows = [(stats[i], y) for i, y in known.items() if i in stats and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    model = quality.Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3))
    z = model.expand(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * max(1.0, len(z) / 1000) * np.eye(z.shape[1]), z.T @ y)

    def fit(rows):
        seen.append(plain(rows))
        return seen[-1]

    quality.fit, before = fit, quality.fit
    try:
        got = {r.doc_id: r.score for r in quality_scores(docs.repartition(7), labels).collect()}
    finally:
        quality.fit = before
    assert seen[0].weights == pytest.approx(want, rel=1e-6, abs=1e-8)
    raw = model.expand(np.array([stats[k] for k in range(400)])) @ want
    order = np.argsort(raw)
    assert (np.diff(np.array([got[k] for k in range(400)])[order]) >= -1e-9).all()


def test_statistics_and_isotonic():
    for t in (None, "", " ", "\n\n", "x", "é" * 10_000, "\x00"):
        assert len(statistics(t)) == N_STATS and np.isfinite(statistics(t)).all()
    x, y = pool_adjacent(np.arange(5.0), np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.ones(5))
    assert (np.diff(y) > 0).all() and y == pytest.approx([0.15, 0.45, 0.9])


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHOWN", 6000)
    docs, labels = labelled(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    test = held(rows, 4, 2)
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == int(r.doc_id % 7 == 0) for r in test]) > 0.97
    assert not any(r.predicted for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())


def test_toxicity_learns_nothing_from_held_out_labels(spark, monkeypatch):
    """Nor from null labels; rows and labels that repeat an id don't multiply the sample."""
    monkeypatch.setattr(toxicity, "SHOWN", 2000)
    docs, labels = labelled(spark, 300)
    lied = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    null = labels.limit(40).withColumn("toxic", F.lit(None).cast("int"))
    taken, plain = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows: (taken.append(rows), plain(rows))[1])
    some = docs.where("doc_id % 7 = 0 AND doc_id < 100")
    runs = [{r.doc_id: r.score for r in toxicity.toxicity_scores(d, x).collect()} for d, x in ((docs, labels), (docs, lied), (docs.union(some).union(some), labels.union(labels.limit(50)).union(null)))]
    assert runs[0] == pytest.approx(runs[1])
    assert [[(x[2], x[1]) for x in rows] for rows in taken] == [[(x[2], x[1]) for x in taken[0]]] * 3


def test_the_sample_is_bounded_and_takes_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * (50_000 if k == 3 else 20)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(400)], "doc_id long, toxic int")
    known = toxicity.labelled(labels)
    size = lambda: sorted(len(x[0]) for x in toxicity.sample(docs, known, "doc_id", "text")[0])
    assert size()[-1] == 50_000 or 3 in {r.label_id for r in known.where("sets").collect()} or zlib.crc32(b"3") % 4 == 2
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2_000)
    assert size() == [20] * 40
    monkeypatch.setattr(toxicity, "FIT_ROWS", 7)
    assert size() == [20] * 14


def test_thresholds_come_from_all_other_labels(spark, monkeypatch):
    """Long texts and rows beyond the fitted ones set thresholds, for a rare language too."""
    monkeypatch.setattr(toxicity, "SHOWN", 3000)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    docs, labels = labelled(spark)
    rare = [(20_000 + k, ("der hund und die katze " * (40 if k % 2 else 4)) + ("idiotron" if k % 4 < 2 else "")) for k in range(160)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rare, "doc_id long, text string"))
    labels = labels.union(spark.createDataFrame([(k, 1, int("idiotron" in t)) for k, t in rare], "doc_id long, quality int, toxic int"))
    seen, plain = [], toxicity.shifts
    monkeypatch.setattr(toxicity, "shifts", lambda counts: (seen.append(counts), plain(counts))[1])
    toxicity.toxicity_scores(docs, labels).count()
    german, taught = toxicity.LANGUAGES.index("de"), lambda k: zlib.crc32(str(k).encode()) % 4 != 2
    assert seen[0][seen[0][:, 0] == german, 4].sum() == sum(taught(k) for k, _ in rare)
    others = seen[0][(seen[0][:, 0] == german) & (seen[0][:, 3] == 0)]
    assert all(others[others[:, 2] == y, 4].sum() >= toxicity.LANGUAGE_ROWS for y in (0, 1))
    assert seen[0][:, 4].sum() == sum(taught(k) for k, in [(r.doc_id,) for r in labels.join(docs, "doc_id").where("toxic IS NOT NULL").collect()])
    counts = np.array([(0, 0, 0, 0, 100), (0, 200, 1, 0, 100), (1, -300, 0, 0, 50), (1, -100, 1, 0, 50)], float)
    base = np.log(0.3 / 0.7)
    assert plain(counts)[:2] == pytest.approx([base - 100.5 / 64, base + 199.5 / 64])


def test_convolution_is_plain():
    """Filters give what a loop over the words gives, at the end of a text too."""
    net = toxicity.Net.start()
    ids = np.array([toxicity.word_ids(w) for w in "a few words here".split()])
    z = net.convolve(net.answers(ids))
    e = net.table[ids >> 20] + net.table[ids & 0xFFFFF]
    for i, width in enumerate(toxicity.WIDTHS):
        for t in range(len(ids)):
            want = sum(e[t + k] @ net.filters[:, toxicity.columns(width, k)] for k in range(width) if t + k < len(ids))
            assert z[t, i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS] == pytest.approx(want, abs=1e-5)
    long = "word scum " * 40_000
    scorer = toxicity.Scorer(net)
    assert scorer.scores([long])[0] == pytest.approx(scorer.scores(["word scum word scum word scum"])[0], abs=1e-3)


def test_languages():
    assert [toxicity.LANGUAGES[toxicity.language(t.split())] for t in ("the cat of it", "der hund und die", "le chat et les", "el gato y los", "zz", "")] == ["en", "de", "fr", "es", "other", "other"]


def write_tables(spark, at, docs, labels, items):
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    """Each stage's decisions, seen on planted documents; null, empty, very long and repeated rows go through."""
    docs, labels = labelled(spark, 600)
    r = random.Random(9)
    passage = " ".join(r.choice(["th", "er", "in", "on", "ath", "esin"]) + str(r.randrange(30)) for _ in range(25))
    long = " ".join("".join(r.choice(["th", "er", "in", "on", "at", "es"]) for _ in range(r.randrange(1, 4))) for _ in range(190))
    planted = [(5001, "The " + long), (5002, "the " + long), (5003, "the " + long + " th"), (5004, f"er in at {passage} on es er"), (5002, "the " + long), (None, long), (None, f"er {passage}"), (5005, None)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    every = every.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(1).alias(c) for c in ("fp0", "digest", "words", "score", "at", "grams", "root", "keep")))
    write_tables(spark, tmp_path, every, labels, [(1, passage), (2, None)])
    assert len(corpus_pipeline.STAGES) == 5
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {x.doc_id: x for x in found}
    assert 5004 not in got and 5001 not in got and len({5002, 5003} & set(got)) == 1
    assert sum(x.doc_id == 5002 for x in found) <= 1 and sum(x.doc_id is None for x in found) == 3  # rows without an id stay
    assert len({9000, 9001, 5005} & set(got)) <= 1  # texts without words are copies of each other
    bad = [k for k in range(600) if k % 5 == 0]
    good = [k for k in range(600) if k % 5]
    assert sum(k in got for k in bad) <= 0.05 * len(bad) and sum(k in got for k in good) >= 0.97 * len(good)
    texts = {x.doc_id: x.text for x in every.collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for k in list(got)[:50]:
        if k is not None:
            assert got[k].n_tokens == len(model.encode(texts[k] or ""))


def test_pipeline_of_no_rows_and_of_no_labels(spark, tmp_path):
    docs, labels = labelled(spark, 20)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    write_tables(spark, f"{tmp_path}/a", docs.limit(0), labels, [(1, "a b")])
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    write_tables(spark, f"{tmp_path}/b", docs, labels.limit(0), [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() >= 20


def test_matching_takes_time_in_proportion_to_the_page():
    """A page of 1 MB with a part of its own for each paragraph is aligned in seconds, and as a small one is."""
    import time

    page = lambda n, other: "<html><body>" + "".join(f"<p>{k}</p>" + ("<div>q</div>" if other and k % 7 == 0 else "<ul><li>x</li></ul>") for k in range(n)) + "</body></html>"
    for n in (60, 30_000):
        template = Template.load(Template.induce(parse(page(n, False))))
        began = time.time()
        assert match(template, parse(page(n, False))) == 3 + 3 * n
        found = aligned(Template.induce(parse(page(n, False))), parse(page(n, True)))
        assert len(found) > 2.5 * n and time.time() - began < 30


def test_a_band_aligns_what_the_whole_table_aligns(monkeypatch):
    import random

    from pagesift.llm import wrapper

    r = random.Random(6)
    for _ in range(20):
        a, b = ("<body>" + "".join(r.choice(("<p>x</p>", "<ul><li>y</ul>", "<h2>z</h2>", "<div>q</div>")) for _ in range(40)) + "</body>" for _ in range(2))
        whole = match(Template.load(Template.induce(parse(a))), parse(b))
        with monkeypatch.context() as m:
            m.setattr(wrapper, "TABLE_CELLS", 900)
            part = match(Template.load(Template.induce(parse(a))), parse(b))
        assert 0.8 * whole <= part <= whole
