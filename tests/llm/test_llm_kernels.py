"""Kernels without Spark, against brute force and the libraries."""

import hashlib
import random
import re
import sys

import numpy as np
import pytest

from shoebox.llm import bpe, common, langid, media, nndescent, omh, packing, suffixdedup, toxicity, webp
from shoebox.llm.suffixes import columnwise


def naive_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("narrow", (0, 12))
def test_aligned(monkeypatch, narrow):
    monkeypatch.setattr(omh, "NARROW", narrow)
    r = random.Random(2)
    for _ in range(1500):
        a, b = (np.array([r.randrange(4) for _ in range(r.randrange(10))], np.uint32) for _ in range(2))
        most, d = r.randrange(7), naive_distance(a.tolist(), b.tolist())
        assert omh.aligned(a, b, most) == (d if d <= most else None)


def test_columnwise():
    r = random.Random(1)
    for trial in range(150):
        docs = [bytes(r.choice(b"ab" if trial % 2 else b"a") for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 8))]
        owner, length, prefix = columnwise(docs, 5)
        found = [docs[a][len(docs[a]) - n :] for a, n in zip(owner, length, strict=True)]
        assert sorted(found) == found and len(found) == sum(len(d) + 1 for d in docs)
        for x, y, p in zip(found, found[1:], prefix[1:], strict=False):
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert p == min(k, 5)


def test_columnwise_files(monkeypatch):
    docs = [b"banana", b"ananas", b""]
    want = columnwise(docs, 9)
    monkeypatch.setattr("shoebox.llm.suffixes.IN_MEMORY", 0)
    assert all(np.array_equal(x, y) for x, y in zip(columnwise(docs, 9), want, strict=True))


def test_anchors_cover_each_substring_once():
    r = random.Random(3)
    o = suffixdedup.Options(match=20, gram=8)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 5, 19, 20, 21, 300, 64)] + [b"ab" * 100]
    at = np.cumsum([0] + [len(t) for t in texts])
    for size in (1 << 20, 37):
        common_slice, suffixdedup.SLICE = suffixdedup.SLICE, size
        key, doc, lo, more = suffixdedup.anchors(np.frombuffer(b"".join(texts), np.uint8), at, o)
        suffixdedup.SLICE = common_slice
        seen = sorted((d, s) for d, a, m in zip(doc.tolist(), lo.tolist(), more.tolist(), strict=True) for s in range(a, a + m + 1))
        assert seen == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 19)]
        by = {}
        for k, d, a, m in zip(key.tolist(), doc.tolist(), lo.tolist(), more.tolist(), strict=True):
            for s in range(a, a + m + 1):
                by.setdefault(texts[d][s : s + 20], set()).add(k)
        assert all(len(v) == 1 for v in by.values())


def test_hash_runs_in_slices(monkeypatch):
    data = np.frombuffer(b"one two three one " * 50, np.uint8)
    starts, ends = common.runs(data != 32)
    want = common.hash_runs(data, starts, ends)
    monkeypatch.setattr(common, "SLICE", 5)
    got = common.hash_runs(data, starts, ends)
    assert np.array_equal(want, got) and len(set(got.tolist())) == 3 and got[0] == got[3]


def test_webp_round_trip():
    r = np.random.default_rng(0)
    runs = [np.zeros(64, np.uint8), r.integers(0, 256, 64 * 9).astype(np.uint8), np.repeat(np.arange(4, dtype=np.uint8), 32), (r.geometric(0.02, 8192) % 256).astype(np.uint8)]
    files = webp.encode_many(np.concatenate(runs), np.cumsum([0] + [len(x) for x in runs]), 64)
    for f, want, fast in zip(files, runs, webp.decode_many(files), strict=True):
        w, h, px = webp.decode(f)
        assert w == 64 and w * h == len(want) and np.array_equal(fast, want)
        assert np.array_equal(px.ravel(), 0xFF000000 | want.astype(np.uint32) << 8)
    with pytest.raises(ValueError):
        webp.decode(files[1][:30])


class Writer:
    def __init__(self):
        self.acc = self.n = 0

    def put(self, value, bits):
        self.acc |= value << self.n
        self.n += bits
        return self

    def one(self, symbol):
        """A code of one symbol."""
        return self.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)

    def two(self, a, b):
        return self.put(1, 1).put(1, 1).put(1, 1).put(a, 8).put(b, 8)

    def file(self, width, height):
        head = Writer().put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)
        head.put(self.acc, self.n)
        body = head.acc.to_bytes((head.n + 7) // 8, "little") + bytes(8)
        body += bytes(len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def flat(w, green, red=0, blue=0, alpha=255, main=False):
    """An image of one colour."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    return w.one(green).one(red).one(blue).one(alpha).one(0)


def test_webp_transforms():
    # subtract green: red and blue get green added
    w = Writer().put(1, 1).put(2, 2).put(0, 1)
    assert webp.decode(flat(w, 10, 3, 250, main=True).file(2, 2))[2].tolist() == [[0xFF0D0A04] * 2] * 2
    # palette of two colours, eight pixels in a byte: 0b00000110
    w = Writer().put(1, 1).put(3, 2).put(1, 8).put(0, 1)
    w.two(1, 7).one(0).one(0).one(0).one(0).put(0, 1).put(1, 1)  # deltas: green 1, then 7
    w.put(0, 1)
    assert webp.decode(flat(w, 0b110, main=True).file(4, 1))[2].tolist() == [[0x100, 0x800, 0x800, 0x100]]
    # predictor 1 (left): first pixel from opaque black, its row from the left, the next row's first from above
    w = Writer().put(1, 1).put(0, 2).put(0, 3)
    flat(w, 1, alpha=0)
    w.put(0, 1)
    got = webp.decode(flat(w, 2, 1, 0, 0, main=True).file(3, 2))[2]
    assert got.tolist() == [[0xFF010200, 0xFF020400, 0xFF030600], [0xFF020400, 0xFF030600, 0xFF040800]]
    # cross-colour: red changes by green * 32 / 32
    w = Writer().put(1, 1).put(1, 2).put(0, 3)
    flat(w, 0, blue=32)
    w.put(0, 1)
    assert webp.decode(flat(w, 5, 1, 1, main=True).file(1, 1))[2].tolist() == [[0xFF060501]]


def test_webp_references_and_cache():
    # symbols: literal 9, then a reference of length 3 one back, then the colour cache
    bits = 4
    lengths = {9: 1, 256 + 2: 2, 280 + ((0x1E35A7BD * 0xFF000900 & 0xFFFFFFFF) >> 28): 2}
    codes = webp.canonical(lengths)
    w = Writer().put(0, 1).put(1, 1).put(bits, 4).put(0, 1)
    w.put(0, 1).put(15, 4).put(webp._INNER_HEAD, 57)
    size, last, tokens = 280 + 16, -1, []
    for s in sorted(lengths):
        gap = s - last - 1
        while gap:
            k = min(gap, 138)
            tokens += [(18, k - 11, 7)] if k > 10 else [(0, 0, 0)] * k
            gap -= k
        tokens.append((lengths[s], 0, 0))
        last = s
    tokens += [(0, 0, 0)] * (size - last - 1)
    w.put(0, 1)
    for s, extra, k in tokens:
        w.put(*webp._INNER_CODES[s]).put(extra, k)
    w.one(0).one(0).one(255).one(1)  # distance code 2: one pixel to the left
    w.put(*codes[9]).put(*codes[258]).put(*codes[max(lengths)])
    assert webp.decode(w.file(5, 1))[2].tolist() == [[0xFF000900] * 5]


def test_media_of_texts():
    texts = [b"", b"abc", b"x" * 64, b"hello world " * 3000]
    at = np.cumsum([0] + [len(t) for t in texts])
    for text, m in zip(texts, media.stored(np.frombuffer(b"".join(texts), np.uint8), at, media.Options()), strict=True):
        back = b"".join(x.tobytes() for x in webp.decode_many(webp.files(m)))
        assert back == text + bytes((-len(text)) % 64 or 64 * (not text))


def test_packing_places_everything():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 1025, 4000)
    for f in (packing.place, packing.best_fit):
        where, offset = f(sizes, 1024)
        for k in range(where.max() + 1):
            own = np.flatnonzero(where == k)
            order = own[np.argsort(offset[own])]
            assert offset[order].tolist() == (np.cumsum(sizes[order]) - sizes[order]).tolist() and sizes[own].sum() <= 1024
    assert packing.best_fit(np.sort(sizes)[::-1], 1024)[0].max() + 1 < 1.01 * sizes.sum() / 1024 + 5


def test_sums_of_squares():
    """Each piece goes where the sum of squares becomes smallest."""
    r = np.random.default_rng(6)
    sizes = r.integers(1, 11, 200)
    where, offset = packing.place(sizes, 10)
    gaps: dict[int, int] = {}
    for s, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
        def after(gap, left):
            count = np.bincount(list(gaps.values()), minlength=11)
            count[0] = 0
            if gap < 10 or w in gaps:
                count[gap] -= gap < 10
            count[left] += left > 0
            return int((count**2).sum())

        options = {g: after(g, g - s) for g in {*gaps.values(), 10} if g >= s and (g > 0)}
        assert options[10 - o] == min(options.values())
        gaps[w] = 10 - o - s


def test_tokenizers_agree():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t, slow, fast = bpe.tokenizer("word_bpe_49k.json"), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["", "Don't STOP'S 12 é!!'s", "a<|endoftext|>B <|STARTOFTEXT|><|startoftext|>", "İstanbul ΣΑΣ ﬁ ŉ ́é", "日本語 かな", "a" * 5000, "\x1c\x85\xa0x"]
    texts += [f"x{chr(c)}y {chr(c)}{chr(c)}\n'{chr(c)}1's" for c in [*range(0x250), *range(0x370, 0x400), 0x2019, 0x1F600, 0x3042]]
    for x in texts:
        assert library.encode(x, add_special_tokens=False).ids == [i for w in t.encode(t.split(x)) for i in w], repr(x)
        assert slow.encode(x, add_special_tokens=False).ids == list(fast(x)), repr(x)


def test_language_cells_and_mixtures():
    o = langid.Options(cells=1 << 12)
    en, de = "the quick brown fox and the lazy dog", "der schnelle braune fuchs und der faule hund"
    model = np.zeros((2, o.cells))
    for i, x in enumerate((de, en)):
        data, starts, ends, _ = common.words([x])
        np.add.at(model[i], langid._cells(data, o.cells)[common.WORD[data]], 1)
    model = np.log((model + 0.01) / (model + 0.01).sum(1, keepdims=True)).astype(np.float32)
    got = langid.infer([en * 9, de * 9, (en + " ") * 9 + (de + " ") * 9, "", None, "123 !!", "é"], ["de", "en"], model, o)
    assert got[0][0] == "en" and got[1][0] == "de" and set(got[2][2]) == {"de", "en"} and [g[0] for g in got[3:6]] == ["und"] * 3 and got[6][0] != "und"
    assert all(0 <= g[1] <= 1 for g in got)


def test_lists_and_counts():
    ids, sims = nndescent._best(np.array([3, 1, 3, 2]), np.array([0.5, 0.9, 0.7, 0.9]), 2)
    assert ids.tolist() == [1, 2] and sims.tolist() == [0.9, 0.9]
    x = toxicity._fit(np.stack([np.linspace(-1, 1, 50), np.ones(50)], 1), (np.linspace(-1, 1, 50) > 0).astype(float), np.ones(50))
    assert x[0] > 1


def test_line_keys():
    from shoebox.llm.linededup import normalised

    assert normalised("  A \t b\r ") == "a b" and re.match(r"^[0-9a-f]{64}$", hashlib.sha256(b"").hexdigest())


def test_webp_encoder_uses_references_where_they_are_smaller():
    r = np.random.default_rng(4)
    words = [bytes(r.integers(97, 123, 9).astype(np.uint8)) for _ in range(20)]
    text = b" ".join(words[i] for i in r.integers(0, 20, 800))[:7936]
    runs = [np.frombuffer(text, np.uint8), r.integers(0, 256, 64 * 5).astype(np.uint8), np.frombuffer(b"a" * 640, np.uint8), np.frombuffer(b"ab" * 320, np.uint8), np.zeros(64, np.uint8)]
    files = webp.encode_many(np.concatenate(runs), np.cumsum([0] + [len(x) for x in runs]), 64)
    for f, want, fast in zip(files, runs, webp.decode_many(files), strict=True):
        assert np.array_equal(fast, want) and np.array_equal(webp.decode(f)[2].ravel(), 0xFF000000 | want.astype(np.uint32) << 8)
    p = np.bincount(runs[0])[np.bincount(runs[0]) > 0] / len(text)
    assert len(files[0]) * 8 < 0.6 * len(text) * -(p * np.log2(p)).sum()  # no code of single bytes gets there


def _images(r, n):
    """Images of many kinds: noise, few symbols, skewed ones whose code is too long, repeats near and far, one symbol, words."""
    word = [bytes(r.integers(97, 123, int(k)).astype(np.uint8)) + b" " for k in r.integers(2, 9, 60)]
    kinds = [
        lambda m: r.integers(0, 256, m),
        lambda m: r.integers(40, 40 + int(r.integers(1, 5)), m),
        lambda m: np.repeat(np.arange(24), np.minimum(2 ** np.arange(24), m))[r.permutation(m) % m],
        lambda m: np.resize(r.integers(0, 256, int(r.integers(1, 300))), m),
        lambda m: np.full(m, int(r.integers(0, 256))),
        lambda m: np.frombuffer(b"".join(word[i] for i in r.integers(0, 60, m))[:m], np.uint8),
    ]
    return [kinds[i % len(kinds)](64 * int(r.integers(1, 129))).astype(np.uint8) for i in range(n)]


def test_webp_many_images_of_many_kinds():
    r = np.random.default_rng(11)
    runs = _images(r, 60)
    files = webp.encode_many(np.concatenate(runs), np.cumsum([0] + [len(x) for x in runs]), 64)
    alone = [webp.encode_many(x, np.array([0, len(x)]), 64)[0] for x in runs]
    assert files == alone  # no image's file depends on its neighbours
    other = flat(Writer().put(0, 1), 10, 3, 250, main=True).file(64, 2)  # another encoder's file between them
    broken = flat(Writer().put(0, 1), 10, 0, 0, main=True).file(2, 2)[:24]
    strange = Writer().put(0, 3).one(10).one(0).one(0).one(255).one(200).file(64, 1)  # a distance that is none and never read
    more = [other, strange]
    for f, want, fast in zip(files + more, runs + [np.full(128, 10, np.uint8), np.full(64, 10, np.uint8)], webp.decode_many(files + more), strict=True):
        assert np.array_equal(fast, want) and np.array_equal(webp.decode(f)[2].ravel() >> 8 & 255, want)
    for bad in (broken, files[5][: len(files[5]) // 2], b"RIFX" + files[0][4:]):
        with pytest.raises(ValueError):
            webp.decode_many([files[0], bad])


def test_webp_code_lengths_cost_no_more_than_huffmans():
    r = np.random.default_rng(3)
    counts = np.where(r.random((40, 90)) < r.random((40, 1)), r.geometric(0.02, (40, 90)), 0)
    counts[0], counts[1] = 0, np.arange(90) == 7
    counts[2, :20] = 2 ** np.arange(20)  # longer than the limit without it
    got = webp.huffman_many(counts, webp.LIMIT)
    assert got.max() <= webp.LIMIT and np.array_equal(got > 0, counts > 0) and got[1].sum() == 1
    many = (counts > 0).sum(1) > 1
    assert ((got[many] > 0) * 0.5 ** got[many]).sum(1).tolist() == [1.0] * many.sum()
    for c, n in zip(counts, webp.huffman_many(counts, 60), strict=True):
        weights, total = sorted(c[c > 0].tolist()), 0
        while len(weights) > 1:
            total += weights[0] + weights[1]
            weights = sorted([weights[0] + weights[1], *weights[2:]])
        assert (c * n).sum() == total or (c > 0).sum() == 1


def test_webp_calls_do_not_grow_with_images():
    """Headers, codes and tokens of a batch are worked on together: Python functions are not called for each image."""

    def calls(n):
        runs = [np.frombuffer((b"%d some words and some more words and a number %d. " % (i, i * 7919) * 8)[:256], np.uint8) for i in range(n)]
        seen = [0]

        def count(frame, event, arg):
            seen[0] += event == "call"

        sys.setprofile(count)
        try:
            webp.decode_many(webp.encode_many(np.concatenate(runs), np.arange(n + 1) * 256, 64))
        finally:
            sys.setprofile(None)
        return seen[0]

    assert calls(400) < 2 * calls(100)
