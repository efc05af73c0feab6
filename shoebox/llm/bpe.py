"""BPE encoding and decoding over a table of distinct words.

Texts are split to words in Spark tasks as the tokenizer splits them. Each block of documents keeps its distinct words and
the numbers of its words in order of position; a bucket gathers the blocks' distinct words, encodes each distinct word of the corpus
once, and the ids go back to the blocks, where they are joined by position (exchange.py). Decoding looks ids up in the
fixed table of pieces, whose size is the vocabulary's, and joins a text's pieces in the order of its ids.

Splitting: texts whose characters all are in PLAIN, a range for which the regex module is known (and tested for each
character) to split as the library does, are split by its pattern; all other texts by the library itself. Special tokens in a text are found
first, as the library does.

Cases: null and empty texts have no ids and decode to an empty text; null ids are passed on; repeated rows are each encoded; a very long text is encoded whole, alone in its block; an empty
table gives an empty one; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import exchange as X


@dataclass(frozen=True)
class Options:
    tokenizer: str = "word_bpe_49k.json"
    #: Bytes of text of a block, and of distinct words (with each block's repetitions) of a bucket.
    block: int = 16 << 20
    bucket: int = 12 << 20


#: Other characters: their text goes to the library's own splitter.
PLAIN = regex.compile(r"[\x00-\x7e\xa1-\xac\xae-\xffĀ-įĲ-ňŊ-ž‐-‧€]*")


class Words:
    """A tokenizer taken apart: how it splits texts to words, the ids of a word, the pieces of ids."""

    def __init__(self, name: str):
        import public_tokenizers as P
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = name if os.path.isabs(name) else P.path(name)
        library = Tokenizer.from_file(path)
        state = json.loads(library.to_str())
        split = next(x for x in state["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.find = regex.compile(self.pattern).findall
        self.normalise = library.normalizer.normalize_str
        self.splitter = pre_tokenizers.Split(Regex(self.pattern), split["behavior"].lower(), invert=split["invert"])
        self.special = {x["content"]: x["id"] for x in state["added_tokens"]}
        self.part = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        state |= {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
        self.one = Tokenizer.from_str(json.dumps(state))
        size = library.get_vocab_size()
        self.pieces = [library.id_to_token(i) or "" for i in range(size)]

    def _slowly(self, text: str) -> list[str]:
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalise(text))]

    def split(self, text: str) -> list[str]:
        if not any(x in text for x in self.special) and PLAIN.fullmatch(text):
            return self.find(text.lower())
        out, at = [], 0
        for m in self.part.finditer(text) if self.part else ():
            if m.start() > at:
                out += self._slowly(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + (self._slowly(text[at:]) if at < len(text) else [])

    def encode(self, words: list[str]) -> list[list[int]]:
        special = self.special
        return [[special[w]] if w in special else e.ids for w, e in zip(words, self.one.encode_batch(words, add_special_tokens=False), strict=True)]


@lru_cache(maxsize=2)
def tokenizer(name: str) -> Words:
    return Words(name)


BLOCK = "block long, docs array<long>, sizes array<long>, seq binary, words binary"
GAP = "\n"  # never in a word


def _pack(o: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, ids = tokenizer(o.tokenizer), X.block_ids()
        for rows in C.chunks(batches, limit=o.block, fill=True):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            parts, sizes = [], []
            for text in rows.column("text").to_pylist():
                words = t.split(text)
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
            row = [next(ids), rows.column("doc_id").to_pylist(), sizes, X.squeeze(np.concatenate(parts), 6), zlib.compress(GAP.join(number).encode(), 6)]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["block", "docs", "sizes", "seq", "words"])

    return run


def _words(packed: bytes) -> list[str]:
    text = zlib.decompress(packed).decode()
    return text.split(GAP) if text else []


def _deal(words: list[str], buckets: int) -> np.ndarray:
    crc = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
    return crc * buckets >> 32


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = _words(r["words"])
                bucket = _deal(words, buckets)
                order = np.argsort(bucket, kind="stable")
                used, at = np.unique(bucket[order], return_index=True)
                if len(used):
                    ends = np.append(at[1:], len(order))
                    keys = [zlib.compress(GAP.join(words[i] for i in order[a:b].tolist()).encode(), 1) for a, b in zip(at, ends, strict=True)]
                    yield pa.record_batch([pa.array([r["block"]] * len(used), pa.int64()), pa.array(used), pa.array(keys, pa.binary()), pa.nulls(len(used), pa.binary())], ["block", "bucket", "keys", "extra"])

    return run


def _dealt(buckets: int):
    """Of each block the buckets of its words, as an answer of its own: so the words need not be shuffled with the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deals = [X.squeeze(_deal(_words(w), buckets).astype(np.uint32)) for w in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([DEAL] * len(deals), pa.int64()), pa.array(deals, pa.binary())], ["block", "bucket", "answer"])

    return run


DEAL = -1


def _encode(o: Options):
    def run(requests: pd.DataFrame) -> list[bytes]:
        asked = [_words(k) for k in requests["keys"]]
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        at = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in asked]
        words, t = list(number), tokenizer(o.tokenizer)
        ids: list[list[int]] = []
        for k in range(0, len(words), 50_000):
            ids += t.encode(words[k : k + 50_000])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = np.cumsum(size) - size
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        out = []
        for own in at:
            n = size[own]
            stop = np.cumsum(n)
            take = np.repeat(begin[own] - (stop - n), n) + np.arange(int(n.sum()))
            out.append(X.squeeze(np.concatenate(([len(own)], n, flat[take])).astype(np.uint32)))
        return out

    return run


def _positions():
    """Of a block: word -> ids, as arrays of where each word's ids begin and end, and the word numbers of each document."""

    def run(block: pd.Series, answers: dict[int, bytes]):
        deal = X.unsqueeze(answers.pop(DEAL), np.uint32)
        order = np.argsort(deal, kind="stable")
        sizes, flats = [], []
        for k in sorted(answers):
            a = X.unsqueeze(answers[k], np.uint32)
            sizes.append(a[1 : 1 + a[0]])
            flats.append(a[1 + a[0] :])
        size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(flats).tolist() if flats else []
        ends = np.cumsum(size).tolist()
        ids: list[list[int]] = [[]] * len(deal)
        for i, n, e in zip(order.tolist(), size.tolist(), ends, strict=True):
            ids[i] = flat[e - n : e]
        seq = X.unsqueeze(block["seq"], np.uint32)
        cut = np.cumsum(np.asarray(block["sizes"], np.int64))
        return ids, np.split(seq, cut[:-1])

    return run


WHOLE = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, o: Options = Options(), digest: bool = False) -> DataFrame:
    """The ids of every text and the text that they decode to; digest: only their number and digests, as DIGEST says."""
    C.tune(docs.sparkSession)
    blocks = C.written(C.texts(docs).mapInArrow(_pack(o), BLOCK))
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    buckets = int(2.5 * size // o.bucket) + 1
    own = blocks.select("block", "words")
    answers = X.answered(own.mapInArrow(_ask(buckets), X.ASK), _encode(o)).unionByName(own.mapInArrow(_dealt(buckets), X.ANSWER))
    joined = _positions()
    schema = DIGEST if digest else WHOLE

    def finish(block: pd.Series | None, own: dict[int, bytes]) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if block is None:
            return pd.DataFrame(columns=names)
        ids, docs_ = joined(block, own)
        pieces = tokenizer(o.tokenizer).pieces
        number = list(map(str, range(len(pieces))))
        out = []
        if digest:
            as_ids = [" ".join([number[i] for i in x]) for x in ids]
            as_text = [" ".join([pieces[i] for i in x]) for x in ids]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
            for seq in docs_:
                at = seq.tolist()
                out.append((int(count[seq].sum()) if at else 0, sha(map(as_ids.__getitem__, at)), sha(map(as_text.__getitem__, at))))
        else:
            for seq in docs_:
                own_ids = [i for w in seq.tolist() for i in ids[w]]
                out.append((own_ids, " ".join([pieces[i] for i in own_ids])))
        doc = pd.array([None if d is None or d != d else int(d) for d in block["docs"]], "Int64")
        return pd.DataFrame({"doc_id": doc} | dict(zip(names[1:], zip(*out, strict=True), strict=True)))

    return X.returned(blocks.drop("words"), answers, finish, schema)
