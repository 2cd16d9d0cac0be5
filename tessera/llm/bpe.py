"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every distinct word of a slice of texts. A
sequence is the BPE encoding of its word exactly if each adjacent pair of tokens is what
BPE makes of the two tokens' joint text, so all adjacent pairs of all proposals are
looked up in one sorted array of judged pairs (numpy); pairs never seen before are judged
once by merging their short joint text. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_slices, ship

ship(__name__)
END, SUFFIX = "\x00", "</w>"
CACHE, LONG = 300_000, 100
#: What str.split() takes for white space and the vocabulary's normaliser doesn't.
CONTROL, SPACE = regex.compile("[\x1c-\x1f]"), regex.compile(r"\S+")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBPE:
    """A word-end BPE vocabulary in the JSON format of the tokenizers library.

    The normaliser is NFC, white space to one space, lower case; words are what the split
    pattern of the file matches, as bytes; special tokens are found in the raw text.
    Words longer than every token and words of any script are handled alike.
    """

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == SUFFIX and not model["ignore_merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word_re = regex.compile(split["pattern"]["Regex"])
        own = lambda t: t[: -len(SUFFIX)] + END if t.endswith(SUFFIX) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.written = dict(map(reversed, self.special.items())) | {i: t for t, i in model["vocab"].items()}
        self.written = [self.written.get(i, "") for i in range(max(self.written) + 1)]
        self.text = [""] * len(self.written)
        for t, i in self.ids.items():
            self.text[i] = t
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids, merges = self.ids, {}
        self.made: list[int] = []
        for k, (x, y) in enumerate(pairs):
            merges.setdefault(ids[own(x)] << 20 | ids[own(y)], k)
            self.made.append(ids[own(x) + own(y)])
        self.rank = merges
        self.longest = ahocorasick.Automaton()
        for t, i in ids.items():
            self.longest.add_word(t, (i, len(t)))
        self.longest.make_automaton()
        self.bytes = dict(enumerate(byte_chars()))
        self.known: dict[str, bytes] = {}
        self.codes, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)

    def symbols(self, s: str) -> list[int]:
        parts = list(s)
        if len(parts) > 1 and parts[-1] == END:
            parts[-2:] = [parts[-2] + END]
        return [self.ids[p] for p in parts]

    def merged(self, s: str) -> list[int]:
        """Exact BPE: the lowest-ranked merge first, then the leftmost."""
        out, rank, made, none = self.symbols(s), self.rank.get, self.made, len(self.made)
        if len(out) > LONG:
            return self.merged_long(out)
        ranks = [rank(a << 20 | b, none) for a, b in zip(out, out[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            out[i] = made[r]
            del out[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(out[i - 1] << 20 | out[i], none)
            if i < len(ranks):
                ranks[i] = rank(out[i] << 20 | out[i + 1], none)
        return out

    def merged_long(self, parts: list[int]) -> list[int]:
        """The same by a heap, in O(n log n)."""
        n, rank = len(parts), self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := rank(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def judge(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code, first * 2**32 + second + 1 (second -1: none), whether BPE keeps both tokens."""
        fresh = np.setdiff1d(codes, self.codes)
        if len(fresh):
            if len(self.codes) > 4 * CACHE:
                self.codes, self.valid = np.zeros(0, np.int64), np.zeros(0, bool)
                fresh = np.unique(codes)
            good = []
            for a, b in zip((fresh >> 32).tolist(), ((fresh & 0xFFFFFFFF) - 1).tolist(), strict=True):
                good.append(self.merged(self.text[a] + self.text[b]) == [a, b] if b >= 0 else self.merged(self.text[a]) == [a])
            every = np.concatenate([self.codes, fresh])
            order = np.argsort(every)
            self.codes, self.valid = every[order], np.concatenate([self.valid, np.array(good, bool)])[order]
        return self.valid[np.searchsorted(self.codes, codes)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, in the vocabulary's characters and with END, as bytes."""
        found = list(self.longest.iter_long("".join(words)))
        flat = np.array([v[0] for _, v in found], np.int64)
        covers = np.array([v[1] for _, v in found], np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        upto = np.searchsorted(np.array([e for e, _ in found], np.int64), ends)
        start = np.append(0, upto[:-1])
        # A proposal must spell the whole word; one that leaves the word's end mark alone doesn't.
        spelled = np.append(0, np.cumsum(covers))
        fine = (spelled[upto] - spelled[start] == size) & (upto > start)
        nxt = np.append(flat[1:], 0)
        nxt[upto[upto > start] - 1] = -1
        first = start[fine & (upto - start == 1)]
        pair = nxt >= 0
        pair[first] = True
        bad = np.zeros(len(flat), bool)
        bad[pair] = ~self.judge((flat[pair] << 32) + nxt[pair] + 1)
        failing = np.append(0, np.cumsum(bad))
        fine &= failing[upto] == failing[start]
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] if ok else np.array(self.merged(w), "<u4").tobytes() for w, a, b, ok in zip(words, start.tolist(), upto.tolist(), fine.tolist(), strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of the chunks, texts without white space, into known."""
        split = [self.word_re.findall(c) for c in chunks]
        own = [(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.bytes)) + END for ws in split for w in ws]
        ids = iter(self.encode_words(own) if own else ())
        for c, ws in zip(chunks, split, strict=True):
            self.known[c] = b"".join(next(ids) for _ in ws)

    def chunks(self, text: str) -> list[str]:
        """No word has white space, so each stretch without it is encoded by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # A capital sigma is lowered without regard to its neighbours.
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        return SPACE.findall(text) if CONTROL.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        special, split = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}, []
        for text in texts:
            if self.special_re and "<|" in text:
                parts = self.special_re.split(text)
                split.append([w for k, p in enumerate(parts) for w in ([(p,)] if k % 2 else self.chunks(p))])
            else:
                split.append(self.chunks(text))
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        known.update({(t,): b for t, b in special.items()})
        if fresh := [w for w in set().union(*split) if w not in known]:
            self.learn(fresh)
        return [b"".join(map(known.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The file names no decoder, so tokens are joined by spaces, special ones too."""
        return " ".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep_ids also ``ids`` (array) and ``decoded``.

    vocabulary: the file's path, read on the driver. A null text counts as empty and has no
    tokens; ties, repeated rows and an empty table need no rule; other columns are not read.
    """
    import hashlib

    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(part, bpe):
        ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
        out = {"doc_id": part.column("doc_id"), "n_tokens": [len(b) // 4 for b in ids], "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids]}
        decoded = map(bpe.decode, ids)
        if keep_ids:
            decoded = list(decoded)
            out |= {"ids": [np.frombuffer(b, "<u4").astype(np.int64) for b in ids], "decoded": decoded}
        return out | {"decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded]}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_slices(slim, run, SCHEMA + (", ids array<bigint>, decoded string" if keep_ids else ""), start=lambda: WordBPE(spec.value))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return encode(docs, vocabulary_path(), keep_ids=True).drop("decoded")
