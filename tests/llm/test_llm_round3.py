"""Whitening, importance resampling and main text: against brute force, and on tables with nulls, repeats and odd columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import common, nndescent, pages, queries, resampling, whitening

SF = "/root/testdata/sf0.001"


def integer_steps(vectors):
    return np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000


def test_whitening_against_numpy(spark):
    table = common.table(spark, SF, "embeddings").collect()
    got = queries.op11_whitening(spark, SF).toPandas()
    x = integer_steps([r["embedding"] for r in table])
    n, sums = len(x), x.sum(0)
    away = x - sums / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    want = away @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    place = {r["vec_id"]: i for i, r in enumerate(table)}
    out = np.zeros_like(want)
    out[got["vec_id"].map(place), got["component"] - 1] = got["whitened"]
    assert len(got) == n * 32 and set(got["n"]) == {n}
    assert np.abs(out * np.sign((out * want).sum(0)) - want).max() < 1e-8
    exact = {r["vec_id"]: sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums)) for i, r in enumerate(table)}
    assert all(exact[v] == d for v, d in zip(got["vec_id"], got["deviation"]))
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values[::-1][:32] / values.sum(), rtol=1e-9) and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-8


def test_moments_merge_as_if_they_were_one():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (1000, 7)) + 1_000_000
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 13, 500, 501])]
    while len(parts) > 1:
        parts = [a[0].merge(a[1]) if len(a) == 2 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    away = x - x.mean(0)
    assert parts[0].n == 1000 and parts[0].sums == x.sum(0).tolist() and np.allclose(parts[0].scatter, away.T @ away, rtol=1e-10, atol=1e-6)


def test_whitening_cases(spark):
    rng = random.Random(5)
    vectors = [[rng.random(), rng.random(), 0.25] for _ in range(40)]
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)] + [
        (7, vectors[7], 1, "x"), (None, vectors[1], 1, "x"), (50, None, 1, "x"), (51, [1.0, None, 2.0], 1, "x"), (52, [1.0, float("nan"), 2.0], 1, "x"), (53, [1.0, float("inf"), 2.0], 1, "x"), (54, [], 1, "x"), (55, [1.0, 2.0], 1, "x"),
        (56, [1e300, -1e300, 0.25], 1, "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened string").repartition(5)
    out = whitening.whitened(table).collect()
    assert Counter(r["vec_id"] for r in out) == Counter([*range(40), 7, None, 56])
    assert all(len(r["whitened"]) == 3 and r["whitened"][2] is None and r["n"] == 43 for r in out)
    assert whitening.whitened(table.limit(0)).count() == 0 and whitening.by_component(whitening.whitened(table.limit(0))).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [r["whitened"] for r in same] == [[None, None]] * 3 and {r["deviation"] for r in same} == {0}


FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def brute_features(text):
    words = FEATURE_WORD.findall((text or "").translate(ASCII_LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target):
    seen = [(i, *brute_features(t)) for i, t in docs]
    source, wanted = Counter(f for _, _, fs in seen for f in fs), Counter(f for t in target for f in brute_features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, n, fs in seen:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in fs)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: 5 * len(able) // 100]


def test_resampling_against_crc32_of_strings(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    rows, chosen = brute_resample(docs, [r["text"] for r in common.table(spark, SF, "benchmark").collect()])
    got = {r["doc_id"]: tuple(r) for r in queries.op12_importance_resampling(spark, SF).collect()}
    rank = {r[0]: k for k, r in enumerate(chosen, 1)}
    assert chosen and got == {r[0]: (r[0], r[2], r[3], r[4], rank.get(r[0])) for r in rows}


def test_resampling_cases(spark):
    rng = random.Random(9)
    words = ["été", "naïve", "x" * 63, "y" * 64, "z" * 65, "W" * 5000, "42", "日本語", "a", "B", "\U0001f600"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "-", " ", "_"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(90)] + [(3, "a b"), (None, None), (None, text(30)), (200, ""), (201, text(3000)), (202, "one"), (202, "one")]
    docs += [docs[5], docs[5]]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank long, part int").repartition(6)
    target = spark.createDataFrame([(text(50),), (None,)], "text string")
    rows, chosen = brute_resample(docs, [r["text"] for r in target.collect()])
    got = resampling.resample(table, target).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in chosen]
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(chosen) + 1))
    assert resampling.resample(table.limit(0), target).count() == 0
    nothing = resampling.resample(table, target.limit(0))
    assert nothing.count() == len(docs)
    assert {r["doc_id"] for r in resampling.drawn(table, target).collect()} == {r[0] for r in chosen}


def test_crc_shifts():
    rng = random.Random(2)
    for n in (0, 1, 2, 63, 64, 65, 1000, 123457):
        a, b = bytes(rng.randrange(256) for _ in range(20)), bytes(rng.randrange(256) for _ in range(min(n, 5000))) + b"q" * max(0, n - 5000)
        crc = np.array([zlib.crc32(a)], np.uint32)
        assert int(resampling.shifted(crc, np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


ODDS = {k: max(-pages.LOOK, min(pages.LOOK, math.log(a / b))) for k, (a, b) in pages.SEEN.items()}


def test_minimum_cut_against_all_cuts():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        price = lambda side: sum(max(0, c) if not s else max(0, -c) for c, s in zip(costs, side)) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        assert price(pages.minimum_cut(costs, edges)) <= min(map(price, itertools.product([False, True], repeat=n))) + 0.02


def test_main_text_of_all_given_pages(spark):
    import html

    for r, text in ((r, t) for r, t in zip(common.table(spark, SF, "pages").orderBy("page_id").collect(), queries.op13_html_main_text(spark, SF).orderBy("page_id").collect())):
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert tuple(text) == (r["page_id"], r["url"], "\n".join(filter(None, want)), len("\n".join(filter(None, want))))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (
            '<html><body class="has-sidebar"><div id="header"><a href=/>Home</a> Site name</div><div class="cookie-notice">We use cookies. Accept?</div><div id="wrap"><div class="text"><h2>A title</h2>'
            '<p>This is the first paragraph, which goes on for a while, as it should, and ends here.<p>The second has <a href=x>a link</a> and <span class="ad">BUY NOW</span>more words, so that it is long enough.</p>'
            '<ul><li>First item of the list in the text.<li>Second item, also there.</ul></div><div class="sidebar"><h3>Related</h3><ul><li><a>One more</a><li><a>Two more</a></ul></div></div>'
            "<section id=comments><article class=comment>I like this text very much, it is the best I have read in years.</article></section><form><label>Name</label><textarea>type here</textarea><button>Send</button></form>"
            "<noscript>enable js</noscript><footer>© 2020</footer><!-- unclosed <p>never seen",
            "A title\nThis is the first paragraph, which goes on for a while, as it should, and ends here.\nThe second has a link and more words, so that it is long enough.\nFirst item of the list in the text.\nSecond item, also there.",
        ),
        (
            "<body><main><article><header><h1>Big</h1><p class=byline>By me</p></header>Some text a &lt; b &amp;amp; c&nbsp;d &#x41;&#66;<table><tr><td>1<td>2</table><pre> x\n y </pre><p>end<!-- c > d --> of it</p>"
            "<footer>tags</footer></article><aside>no</aside></main><script>if (a<b) \"</p>\"</script><p",
            "Big\nSome text a < b &amp; c d AB\n1\n2\nx y\nend of it",
        ),
        ('<article><p>One <a title="a>b" href=\'x\'>two</a> three<br>four &am<b>p;</b> &copy</p></article><div style="display:none">hidden</div>', "One two three four &amp; ©"),
        ("", ""), ("a < b", "a < b"), ("<p", ""), ("<!-->", ""), ("</p></div>", ""), ("<script>x", ""),
    ],
)
def test_main_text_of_pages(page, text):
    assert pages.extract(page, ODDS) == text


def test_main_text_cases(spark):
    long = "<article>" + "<p>A paragraph of the long page, which says little.</p><b>" * 20000
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<article>x</article>", "t"), (3, "u", long, "t"), (4, "u", "<div>" * 30000 + "deep", "t"), (4, "u", "<div>" * 30000 + "deep", "t"), (5, "u", "<b>" * 30000 + "</i>" * 30000 + "<hr>" * 30000, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {(r["page_id"], r["url"]): r for r in pages.main_text(table).collect()}
    assert len(got) == 6 and got[1, "u"]["text"] == "" and got[2, None]["n_chars"] == 0 and got[None, "u"]["text"] == "x"
    assert got[3, "u"]["text"] == "\n".join(["A paragraph of the long page, which says little."] * 20000)
    assert pages.main_text(table.limit(0)).count() == 0


def test_audit_of_rare_links(spark):
    """A table with one linked pair among 3,000: the audit says that it cannot tell, and the pair is found."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[2999] = x[17] + rng.normal(size=24) * 0.01
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    packed = table.select(F.xxhash64("embedding").alias("node"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("n"), F.col("vec_id").alias("first"))
    nodes = common.written(packed.mapInArrow(nndescent._pack("<f8"), "node long, vec binary, dim int, n long, first long"))
    o = nndescent.Options(audited=16, linked=8)
    nothing = spark.createDataFrame([], "node long, links long")
    assert nndescent.audit(nodes, nothing, "<f8", o) == (0.0, False)
    assert nndescent.audit(nodes, nothing, "<f8", o, near=nodes.limit(3).select("node"))[1] is False
    assert nndescent.audit(nodes.limit(10), nothing, "<f8", o) == (1.0, True)  # all of them were looked at
    got = {r.vec_id: r for r in nndescent.link(table, o).collect()}
    assert len(got) == 3000 and {i for i, r in got.items() if r.n_links} == {17, 2999} and got[2999].component_id == 17
