"""Operators on small tables with nulls, ties, repeated rows, clashing columns, and against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoebox.llm import bpe, common, graph, langid, linededup, lm, media, nndescent, omh, packing, queries, resampling, suffixdedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, score double, block long, words string, removed string, node long"
LONG = " ".join(f"word{i % 977}" for i in range(30000))
SHARED = "It is only with the heart that one can see rightly; what is essential is invisible to the eye, said the fox to the prince, and he repeated it so that he would be sure to remember."


def rows():
    body = " ".join(f"token{i} is here" for i in range(60))
    values = [
        (1, "alpha beta gamma\nalpha beta gamma\n\nshort", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (5, body, "de"), (6, body, "de"), (7, body.replace("token7 ", "other "), "fr"),
        (5, body, "de"), (None, body, None), (None, None, "en"), (8, "x " + SHARED + " y", "en"), (9, "quite another beginning, then " + SHARED, None), (10, "!!! 123 …", "en"), (11, "é", "fr"),
        (12, "ALPHA  beta\tGamma", "en"), (12, "a different text with the same id", "en"),
    ]
    return [(i, t, g, "s", None, 7, 0.5, 3, "w", "r", 9) for i, t, g in values]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def real(spark):
    return common.table(spark, SF, "documents")


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


ALL = Counter(r[0] for r in rows())


def test_lm_against_brute_force(docs, none, real):
    assert lm.score(none).count() == 0
    out = lm.score(docs)
    assert ids(out) == ALL and out.filter("doc_id is null and held_out is not null").count() == 0
    o = lm.Options()
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [None]
    texts = {r.doc_id: token(r.text) for r in real.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    one, two = Counter(), Counter()
    for i, t in texts.items():
        if not held[i]:
            one.update(t)
            two.update(zip(t, t[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    for r in lm.score(real).collect():
        t = texts[r.doc_id]
        base = sum(math.log10(p(w)) for w in t)
        arcs = (math.log10((two[u, w] + o.mass * p(w)) / (one[u] + o.mass)) if one[u] else math.log10(p(w)) for u, w in zip(t, t[1:], strict=False))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(math.log10(p(t[0])) + sum(arcs))


def test_bpe(docs, none, real):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    assert bpe.encode(none).count() == 0 and ids(bpe.encode(docs)) == ALL
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = {r.doc_id: r for r in bpe.encode(real).collect()}
    short = {r.doc_id: r for r in bpe.encode(real, digest=True).collect()}
    for r in real.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(whole[r.doc_id].ids) == want and whole[r.doc_id].decoded == library.decode(want, skip_special_tokens=False)
        d = short[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(whole[r.doc_id].decoded.encode()).hexdigest())


def test_media(docs, none):
    assert media.features(none).count() == 0
    out = media.features(docs)
    assert ids(out) == ALL
    for r in out.filter("doc_id in (3, 5)").collect():
        text = dict((x[0], x[1]) for x in rows())[r.doc_id].encode()
        payload = text + bytes((-len(text)) % 64 or 64 * (not text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out.filter("doc_id in (5, 6)").select("media_sha256", "feature").distinct().count() == 1


def test_packing(docs, none, real):
    assert packing.pack(none).count() == 0
    assert set(ids(packing.pack(docs))) == set(ALL)
    out = packing.pack(real, packing.Options(shard=50)).toPandas()
    encode = packing.encoder("byte_bpe_50k.json", None)
    for r in real.collect():
        want = np.append(encode(r.text or ""), np.uint32(2)).astype("<u4")
        own = out[out.doc_id == r.doc_id].sort_values("piece")
        assert own.length.sum() == len(want) and (own.start.to_numpy() == own.length.cumsum().to_numpy() - own.length.to_numpy()).all()
        assert [zlib.crc32(want[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
        assert (own.length.iloc[1:] == 1024).all()
    placed = out.sort_values(["sequence_id", "offset"])
    total = placed.groupby("sequence_id").length
    assert total.sum().max() <= 1024 and (total.cumsum() - placed.length == placed.offset).all()


def test_omh(docs, none, real):
    assert omh.classes(none).count() == 0
    got = omh.classes(docs).toPandas()
    group = {k: set(g.doc_id.dropna().astype(int)) for k, g in got.groupby("class_id", dropna=False)}
    assert group[5] == {5, 6, 7} and group[2] == {2, 3} and ids(omh.classes(docs)) == ALL
    assert got[got.class_id == 5].class_size.eq(5).all()  # the repeated row and the one without an id too
    text = {r.doc_id: r.text for r in real.collect()}
    words = {}
    for i, t in text.items():
        data, a, b, _ = common.words([t])
        words[i] = (common.hash_runs(data, a, b) >> np.uint64(32)).astype(np.uint32)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, w.tolist()) for i, w in words.items())}
    label = {r.doc_id: r.class_id for r in omh.classes(real).collect()}
    for a in text:
        for b in text:
            if a < b and len(words[a]) and len(words[b]) and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                if omh.aligned(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) is not None:
                    assert label[a] == label[b], (a, b)
    kept = omh.representatives(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (5, 6, 7)").count() == 1


@pytest.mark.parametrize("part, dealt", [(omh.PART, omh.DEALT), (1, 2)])
def test_omh_links_that_are_not_transitive(spark, monkeypatch, part, dealt):
    """Texts of one bucket, each 12 edits further from the first: only neighbours in the chain are similar."""
    monkeypatch.setattr(omh, "PART", part)
    monkeypatch.setattr(omh, "DEALT", dealt)
    word = lambda *n: "".join("abcdefghij"[int(d)] for d in "".join(f"{x:02}" for x in n))
    texts = []
    for chain in range(3):
        words = [word(chain, 99, i) for i in range(100)]
        for step in range(6):
            texts.append(" ".join(words))
            words[step * 12 : step * 12 + 12] = [word(chain, step, i) for i in range(12)]
    order = [0, 1, 2, 6, 12, 8, 7, 13, 9, 3, 4, 5, 10, 11, 14, 17, 16, 15]  # ranks
    nodes = [(i, order.index(i), 100, [7, 7] + [1000 * i + k for k in range(30)]) for i in range(len(texts))]
    nodes, texts = spark.createDataFrame(nodes, "node long, rank long, n_words long, keys array<long>"), spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    assert {(r.node, r.label) for r in omh._linked(nodes, texts, omh.Options()).collect()} == {(i, i // 6 * 6) for i in range(18)}


def test_suffix_dedup(docs, none, real):
    assert suffixdedup.dedup(none).count() == 0 and ids(suffixdedup.dedup(docs)) == ALL
    row = suffixdedup.dedup(docs).filter("doc_id = 9").first()
    assert len(row.removed) == 1 and row.removed[0]["stop"] - row.removed[0]["start"] == len(SHARED) + 1 and bytes(row.kept).decode() + SHARED == "quite another beginning, then" + SHARED
    for o in (suffixdedup.Options(), suffixdedup.Options(hot=5, anchors=2000, bucket=1 << 14, chunk=1 << 16)):
        seen, got = set(), {r.doc_id: r for r in suffixdedup.dedup(real, o, digest=True).collect()}
        for r in sorted(real.collect(), key=lambda r: r.doc_id):
            b = (r.text or "").encode()
            mark = np.zeros(len(b), bool)
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    mark[k : k + 100] = True
                else:
                    seen.add(b[k : k + 100])
            starts, _ = common.runs(mark)
            g = got[r.doc_id]
            assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(b), mark.sum(), len(starts), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    clean = suffixdedup.cleaned(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()


def test_line_dedup(spark, docs, none):
    assert linededup.dedup(none).count() == 0
    got = {r.doc_id: r for r in linededup.dedup(docs).filter("doc_id in (1, 3, 10)").collect()}
    assert (got[1].n_units, got[1].n_units_removed, got[1].n_removed, got[1].text) == (4, 1, 16, "alpha beta gamma\n\nshort") and got[1].removed[0]["start"] == 17 and got[3].n_removed == 0
    assert ids(linededup.dedup(docs)) == ALL
    twelve = linededup.dedup(docs).filter("doc_id = 12").agg(F.sum("n_units_removed")).first()[0]
    assert twelve == 1  # the same words in other case and spacing
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(linededup.SQL).fetchall()
    names = [d[0] for d in con.sql(linededup.SQL).description]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[n] for n in names)) for r in queries.op10_line_dedup(spark, SF).collect())


def test_line_dedup_of_short_units(spark):
    texts = ["Menu\n这是一个很长的句子没有空格\nhttps://example.org/a", "这是一个很长的句子没有空格\nmenu\n\nhttps://example.org/a\nown", "全角\u3000空格\n全角\u3000空格"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_units_removed, r.text) for r in linededup.dedup(df).collect()}
    assert got == {0: (0, texts[0]), 1: (3, "\nown"), 2: (1, "全角\u3000空格")}
    paragraphs = linededup.dedup(spark.createDataFrame([(0, "a\nb\n\nc"), (1, "x\n\na\nB"), (2, "a\n\nb")], "doc_id long, text string"), linededup.Options(separator="\n\n"))
    assert {r.doc_id: (r.n_units_removed, r.n_removed, r.text) for r in paragraphs.collect()} == {0: (0, 0, "a\nb\n\nc"), 1: (1, 3, "x"), 2: (0, 0, "a\n\nb")}
    assert linededup.dedup(df, linededup.Options(min_words=3)).agg(F.sum("n_removed")).first()[0] == 0


def test_toxicity(spark, docs, none, real):
    labels = common.table(spark, SF, "labels")
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (5, 1, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, labels.limit(0)).count() == 0
    out = toxicity.classify(docs, odd)
    assert ids(out) == ALL and out.filter("score = 0 and predicted = 0").count() == docs.count()
    mean = "idiot scum loser trash"
    many = spark.createDataFrame([(i, f"some quite ordinary words number {i % 37} and {i % 11} " + (mean if i % 4 == 0 else "go here")) for i in range(900)], "doc_id long, text string")
    truth = many.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    r = toxicity.classify(many, truth).join(truth, "doc_id").filter(common.crc_mod("doc_id", 3) == 1)
    assert r.filter("predicted = toxic").count() > 0.97 * r.count() and r.filter("score < 0 or score > 1").count() == 0
    model = toxicity.fit(many, truth)
    assert toxicity.clean(many, model).count() < 700
    assert [round(float(x), 6) for x in toxicity.features(model, ["", None, "!!!"])[0][:, :3].ravel()] == [0.0] * 9
    same = toxicity.score(spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string"), model)
    assert same.select("score").distinct().count() == 1


def test_toxicity_models_against_brute_force(spark):
    r = np.random.default_rng(3)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    texts = [(int(k % 4 == 0), [vocabulary[i] for i in r.choice(60, 12, p=p / p.sum())] + (["vile"] * (k % 3) if k % 4 == 0 else [])) for k in range(80)]
    pairs, counts = spark.createDataFrame([(t, y) for y, t in [(y, " ".join(t)) for y, t in texts]], "text string, toxic int"), [Counter(), Counter()]
    for y, t in texts:
        counts[y].update(zip(["<s>", *t[:-1]], t, strict=True))
    model = toxicity._model(pairs.mapInArrow(toxicity._count, "u long, w long, c0 long, c1 long").groupBy("u", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))

    def discount(values, whole):
        of = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        d = toxicity.discounts(of, whole)
        return lambda c: float(d[min(c, 3)])

    both = counts[0] + counts[1]
    words = sorted({w for _, w in both})
    n = Counter(w for _, w in both)
    d = discount(n.values(), False)
    total = sum(n.values())
    spare = sum(d(c) for c in n.values()) / total
    shared = lambda w: (n[w] - d(n[w])) / total + spare / (len(words) + 1)

    def of_class(k):
        own = Counter(w for _, w in counts[k])
        d1, d2 = discount(own.values(), True), discount(counts[k].values(), True)
        size = sum(own.values())
        back = sum(d1(c) for c in own.values()) / size
        one = lambda w: (own[w] - d1(own[w])) / size + back * shared(w)

        def two(u, w):
            after = {x: c for (v, x), c in counts[k].items() if v == u}
            s = sum(after.values())
            return one(w) if not s else (after.get(w, 0) - d2(after.get(w, 0))) / s + sum(map(d2, after.values())) / s * one(w)

        return one, two

    (one0, two0), (one1, two1) = of_class(0), of_class(1)
    unknown = "neverseen"
    for one, two in ((one0, two0), (one1, two1)):
        assert sum(map(one, words)) + one(unknown) == pytest.approx(1)
        for u in ("<s>", *words[:10], "vile", unknown):
            assert sum(two(u, w) for w in words) + two(u, unknown) == pytest.approx(1)
    text = [*words, "vile", "vile", unknown, words[0], words[3]]
    got, alone, _ = toxicity.differences(model, [" ".join(text)])
    assert alone == pytest.approx([math.log(one1(w) / one0(w)) for w in text], abs=1e-5)
    assert got == pytest.approx([math.log(two1(u, w) / two0(u, w)) for u, w in zip(["<s>", *text[:-1]], text, strict=True)], abs=1e-5)


@pytest.mark.parametrize("bound", [2400, 6000])
def test_toxicity_whatever_the_bound(spark, bound):
    """The share of toxic documents found and of others left alone, on held-out rows, whether the bound on labelled rows binds or not."""
    sf = "/root/testdata/sf0.1"
    labels, o = common.table(spark, sf, "labels"), toxicity.Options(max_docs=bound)
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    r = toxicity.classify(common.table(spark, sf, "documents"), labels, o).join(truth, "doc_id").filter(common.crc_mod("doc_id", 3) == 1)
    found = {(x.toxic, x.predicted): x["count"] for x in r.groupBy("toxic", "predicted").count().collect()}
    assert found[1, 1] > 0.85 * (found[1, 1] + found[1, 0]) and found.get((0, 1), 0) < 0.01 * found[0, 0]


def test_languages(docs, none, spark):
    assert langid.identify(none).count() == 0
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert ids(langid.identify(docs)) == ALL and out[2].lang_pred == out[3].lang_pred == out[10].lang_pred == "und" and out[10].score == 0
    sf = "/root/testdata/sf0.01"
    real = common.table(spark, sf, "documents").select("doc_id", "lang")
    r = queries.op9_language_id(spark, sf).join(real, "doc_id").filter("held_out")
    assert r.filter("lang = lang_pred").count() > 0.95 * r.count()


def test_languages_of_a_text_in_five():
    kinds = ["aaaa", "eeee", "iiii", "oooo", "uuuu"]
    model = np.full((5, 1 << 12), -12.0)
    for i, w in enumerate(kinds):
        data, starts, ends, _ = common.words([w])
        model[i, langid._cells(data, 1 << 12)[common.WORD[data]]] = -1.0
    mixed = " ".join(kinds * 40)
    alone, *_ = langid.infer([mixed], list("vwxyz"), model)
    assert sorted(alone[2]) == list("vwxyz")
    assert langid.infer([mixed, "aaaa " * 50], list("vwxyz"), model)[0] == alone


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 16))
    near = np.concatenate([base[:40] + r.normal(size=(40, 16)) * 0.05, base[:1] + r.normal(size=(60, 16)) * 0.08])
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 7, 1), (904, [1.0] * 7, 1), (None, x[0].tolist(), 1), (905, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    o = nndescent.Options(leaf=60, tile=32, k=6)
    got = {r.vec_id: r for r in nndescent.link(df, o).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    for i in range(len(x)):
        assert got[i].n_links == linked[i].sum() + linked[i, 0] + (i == 0), i  # the vector without an id is the first one's equal
    assert (got[903].n_links, got[904].component_id, got[900].component_id, got[901].n_links, got[905].kept) == (1, 903, 900, 0, True)
    edges = spark.createDataFrame([(i, j) for i in range(len(x)) for j in np.flatnonzero(linked[i]).tolist() if i < j], "a long, b long")
    for r_ in graph.components(edges).collect():
        assert got[r_.node].component_id == r_.label
    assert nndescent.link(df.limit(0), o).count() == 0


def test_vectors_audit_and_exact_pass(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(200, 16))
    x = np.concatenate([base, base[:40] + r.normal(size=(40, 16)) * 0.02, base[:1] + r.normal(size=(60, 16)) * 0.02]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    nodes = spark.createDataFrame([(i, v.tobytes(), 16, 1, i) for i, v in enumerate(x)], "node long, vec binary, dim int, n long, first long")
    group = [0, *range(240, 300)]
    links = spark.createDataFrame([(i, int(linked[i].sum())) for i in group], "node long, links long")
    recall, enough = nndescent.audit(nodes, links, "<f4", nndescent.Options())
    assert enough and recall < 0.7  # the group is whole, all pairs apart from it are missed
    # no search at all: the pass over all blocks finds every link
    for block in (1024, 64):
        old, nndescent.BLOCK = nndescent.BLOCK, block
        try:
            df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
            got = {r_.vec_id: r_ for r_ in nndescent.link(df, nndescent.Options(attempts=0)).collect()}
        finally:
            nndescent.BLOCK = old
        assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
        assert [got[i].component_id for i in range(3)] == [0, 1, 2] and got[201].component_id == 1


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in graph.components(e).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert graph.components(e.limit(0)).count() == 0


def test_pipeline(spark, real):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "suffix_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs, before = real, None
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == real.columns and out.count() <= docs.count()
        before, docs = docs, out
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_scratch_is_the_shared_folder():
    session = lambda value, master="local[2]": SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda key, default=None: value if key == "spark.checkpoint.dir" else default))
    assert common.scratch(session("hdfs:///shared", "yarn")).startswith("hdfs:///shared/shoebox-") and os.path.isabs(common.scratch(session(None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(session(None, "spark://host:7077"))


def test_stages_with_columns_of_any_name(spark, docs):
    names = ["gone", "_gone", "__gone", "_row_key", "__row_key", "row_id", "__row_id", "drawn_id", "__drawn_id"]
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        assert out.select(*names).distinct().collect() in ([], [tuple(range(len(names)))]), name
    kept = omh.representatives(wide)
    assert ids(kept) == ids(omh.representatives(docs)) and kept.filter("gone <> 0 or __row_id <> 6").count() == 0
    assert ids(suffixdedup.cleaned(wide)) == ALL
    assert resampling.drawn(wide, docs).columns == wide.columns
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).select("doc_id").distinct().count() == len(ALL)


def test_omh_classes_are_all_chains_of_links(spark):
    """Whatever the order of comparisons, classes are the components of all similar pairs that share a bucket."""
    rng, o = np.random.default_rng(5), omh.Options()
    word = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    base = [rng.integers(0, 10**6, 120) for _ in range(6)]
    texts = []
    for i in range(160):
        w = base[i % 6].copy()
        w[rng.choice(120, rng.integers(0, 30), replace=False)] = rng.integers(10**6, 10**7, 1)
        texts.append(" ".join(word(x) for x in w))
    sizes, keys = omh.sketches(texts, o)
    nodes = spark.createDataFrame([(i, i, int(sizes[i]), [int(x) for x in keys[i].view(np.int64)]) for i in range(len(texts))], "node long, rank long, n_words long, keys array<long>")
    got = {r.node: r.label for r in omh._linked(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), o).collect()}
    hashes = []
    for t in texts:
        data, a, b, _ = common.words([t])
        hashes.append((common.hash_runs(data, a, b) >> np.uint64(32)).astype(np.uint32))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (keys[a] == keys[b]).any() and omh.aligned(hashes[a], hashes[b], int(0.2 * max(len(hashes[a]), len(hashes[b])) + 1e-9)) is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got.get(i, i) for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 1


def test_omh_finds_similar_pairs_at_each_rate_of_edits(spark):
    """Pairs of texts of 300 words, of which a share is replaced, all similar by edits: how many come into one class."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    rows, rates, each = [], (2, 5, 8, 10, 15), 60
    for rate in rates:
        for _ in range(each):
            w = rng.integers(0, 10**8, 300)
            changed = w.copy()
            changed[rng.choice(300, 3 * rate, replace=False)] = rng.integers(0, 10**8, 3 * rate)
            rows += [(len(rows), " ".join(map(word, w))), (len(rows) + 1, " ".join(map(word, changed)))]
    label = {r.doc_id: r.class_id for r in omh.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - 1) for i, c in label.items())
    found = {rate: np.mean([label[i + 1] == label[i] for i in range(2 * each * k, 2 * each * (k + 1), 2)]) for k, rate in enumerate(rates)}
    assert all(found[rate] >= 0.9 for rate in (2, 5, 8, 10)) and found[15] >= 0.6, found


@pytest.mark.parametrize("dealt", [omh.DEALT, 7])
def test_omh_unlike_texts_with_a_common_passage_are_not_aligned(spark, monkeypatch, dealt):
    """Texts of one bucket that share a passage and no more: their number of alignments does not grow with the square, and the two similar ones among them are found."""
    monkeypatch.setattr(omh, "DEALT", dealt)
    rng, aligned, plain = np.random.default_rng(8), [], omh._tested
    word = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    passage = rng.integers(0, 10**6, 40).tolist()
    own = [rng.integers(10**6, 10**8, 60).tolist() for _ in range(60)]
    own[50] = [*own[20][:55], *own[50][55:]]
    texts = [" ".join(map(word, [*passage, *w])) for w in own]
    nodes = spark.createDataFrame([(i, i, 100, [7, 7, i]) for i in range(60)], "node long, rank long, n_words long, keys array<long>")

    def counted(pairs, words, o):
        aligned.append(pairs.count())
        return plain(pairs, words, o)

    monkeypatch.setattr(omh, "_tested", counted)
    got = omh._linked(nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), omh.Options()).collect()
    assert {r.node: r.label for r in got if r.node in (20, 50)} == {20: 20, 50: 20} and all(r.label == r.node for r in got if r.node not in (20, 50))
    assert sum(aligned) <= 2 * len(texts), aligned
