"""BPE encoding and decoding of a word-level vocabulary (lower case, word ends marked), file format of the tokenizers library.

A word is a contiguous array of parts with the merge rank of each adjacent pair beside it: the smallest rank is
found by scanning, its boundary is deleted, and the two neighbouring ranks are refreshed. New words of a run of texts take
these steps together, as rows of one array, and are cached by their surface form. Words too long for repeated scans keep the
same ranks in a heap; both give the same parts.
"""

from __future__ import annotations

import bisect
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import documents

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SCANNED = 192
SLOTS = 19
CACHED = 150_000
SLICE = 1 << 20
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1, else the next free letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary and merges of a model file, as JSON text."""

    def __init__(self, source: str):
        file = json.loads(source)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        letters = byte_letters()
        self.first = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int32)
        self.merged = np.zeros(len(pairs), np.int32)
        keys, ranks = np.zeros(len(self.merges), np.int64), np.zeros(len(self.merges), np.int64)
        for i, ((a, b), (rank, new)) in enumerate(self.merges.items()):
            keys[i], ranks[i], self.merged[rank] = (a << 32) | b, rank, new
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        self.slot_key, self.slot_rank, self.slot_full = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int64), np.zeros(1 << SLOTS, bool)
        self.slot_key[slot], self.slot_rank[slot], self.slot_full[slot] = keys, ranks, True
        lost = np.flatnonzero(self.slot_key[slot] != keys)
        lost = lost[np.argsort(keys[lost])]
        self.other_keys, self.other_ranks = keys[lost], ranks[lost]
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        split = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace(r"[^\s", f"[^{SPACE}"))
        self.blank = regex.compile(f"[{SPACE}]+")
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        self.control = regex.compile("[\x1c-\x1f]")
        self.cache: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of parts, NONE where there is no merge; a part of -1 is none."""
        keys = (a.astype(np.int64) << 32) | b
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        out = np.where(self.slot_key[slot] == keys, self.slot_rank[slot], NONE)
        unsure = np.flatnonzero((out == NONE) & self.slot_full[slot])  # another pair has the slot
        if len(unsure) and len(self.other_keys):
            at = np.minimum(np.searchsorted(self.other_keys, keys[unsure]), len(self.other_keys) - 1)
            out[unsure] = np.where(self.other_keys[at] == keys[unsure], self.other_ranks[at], NONE)
        return out

    def words(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as int32 bytes, of pre-tokenised pieces of at most SCANNED bytes, each row one contiguous array of parts."""
        size = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(size.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        parts = np.where(column < size[:, None], self.first[raw], -1).astype(np.int32)
        parts[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        ranks = self.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
        out: list[bytes] = [b""] * n
        owner = np.arange(n)
        while True:
            if ranks.shape[1]:
                least = ranks.argmin(1)
                rows = np.arange(len(parts))
                going = ranks[rows, least] < NONE
            else:
                going = np.zeros(len(parts), bool)
            for i, row, m in zip(owner[~going].tolist(), parts[~going], size[owner[~going]].tolist()):
                out[i] = row[:m].tobytes()
            if not going.any():
                return out
            owner, parts, ranks, least = owner[going], parts[going], ranks[going], least[going]
            rows = np.arange(len(parts))
            parts[rows, least] = self.merged[ranks[rows, least]]
            keep = np.ones(parts.shape, bool)
            keep[rows, least + 1] = False
            parts = parts[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, least] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            size[owner] -= 1
            for at in (least - 1, least):  # the ranks on both sides of the new part
                own = np.flatnonzero((at >= 0) & (at < ranks.shape[1]))
                ranks[own, at[own]] = self.ranks(parts[own, at[own]], parts[own, at[own] + 1])

    def learn(self, words) -> None:
        """Add words (free of blanks) to the cache."""
        found = {w: [p.encode() for p in self.pieces.findall(w)] for w in words}
        pieces = sorted({p for own in found.values() for p in own}, key=len)
        ids: dict[bytes, bytes] = {}
        for length in (8, 12, 16, 24, 32, 64, SCANNED):
            own = pieces[len(ids) : bisect.bisect_right(pieces, length, key=len)]
            step = (1 << 19) // length  # bounds the arrays of words()
            for at in range(0, len(own), step):
                some = own[at : at + step]
                ids.update(zip(some, self.words(some)))
        for p in pieces[len(ids) :]:
            ids[p] = np.array(self._long([self.first[b] for b in p[:-1]] + [self.last[p[-1]]]), np.int32).tobytes()
        for w, own in found.items():
            self.cache[w] = ids[own[0]] if len(own) == 1 else b"".join([ids[p] for p in own])

    def rank(self, a: int, b: int) -> int:
        return self.merges.get((a, b), (NONE, 0))[0]

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank(parts[i], parts[i + 1])) < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i] = self.merges[a, b][1]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (r := self.rank(parts[left], parts[right])) < NONE:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, live in zip(parts, alive) if live]

    def split(self, text: str) -> list:
        """A text as the words between blanks, normalised, and the ids of special tokens."""
        out: list = []
        for part in self.special.split(text) if self.special and "<" in text else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += [w for w in self.blank.split(part) if w] if self.control.search(part) else part.split()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, as int32."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        special = {w for w in words if isinstance(w, int)}
        missing = words - special - self.cache.keys()
        if len(self.cache) + len(missing) > CACHED:
            self.cache.clear()
            missing = words - special
        if missing:
            self.learn(missing)
        get = self.cache.__getitem__
        if special:
            known = {**self.cache, **{i: np.int32(i).tobytes() for i in special}}
            get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.int32) for own in split]


def read_model(path: str) -> str:
    """The model file, read on the driver: a fixed size that does not depend on the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _ids(bpe: WordBpe, column: pa.Array):
    """(lo, hi, list array of ids) of runs of rows of about SLICE bytes."""
    column = pc.fill_null(column, "")
    for lo, hi, _, _ in bt.slices(column, SLICE):
        ids = bpe.encode(column.slice(lo, hi - lo).to_pylist())
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        yield lo, hi, pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids), pa.int32()))


def _text(tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """The tokens of each row's ids, joined by spaces."""
    size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    words = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int64), tokens.take(ids.flatten()))
    return pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _mapped(docs: DataFrame, model: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    source = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]

    def run(batches):  # the model is made for each partition, as an idle worker would keep it
        bpe = WordBpe(source.value)
        tokens = pa.array(bpe.tokens, pa.large_string())
        for batch in batches:
            for lo, hi, ids in _ids(bpe, batch.column(1)):
                columns = [batch.column(0).slice(lo, hi - lo), ids, *([_text(tokens, ids)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(bt.frugal(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>. model: the JSON text of the model file.

    Null and empty texts have no ids. Special tokens in a text are recognised, as the library does by default. Rows keep
    their order and repeat as they do; other columns are ignored.
    """
    return _mapped(docs, model, id_col, text_col, False)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with decoded, as decode() gives it, in one pass of one Python worker."""
    return _mapped(docs, model, id_col, text_col, True)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded: the tokens of ids joined by spaces, as this kind of model decodes. Null ids give the empty string."""
    source = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"

    def run(batches):
        tokens = pa.array(WordBpe(source.value).tokens, pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                text = _text(tokens, some.column(some.schema.get_field_index(ids_col)))
                yield pa.RecordBatch.from_arrays([*some.columns, text], [*some.schema.names, "decoded"])

    return rows.mapInArrow(bt.frugal(run), schema)


def public_model() -> str:
    import public_tokenizers

    return read_model(public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, model, id_col, text_col).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_model())
