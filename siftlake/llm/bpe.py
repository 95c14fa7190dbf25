"""BPE encoding and decoding with a contiguous rank array.

Short words hold their part ids and the ranks of adjacent parts in two plain arrays; the smallest rank is looked for
again and again, one boundary is deleted and the two neighbouring ranks are refreshed. Words of more than ``SHORT``
bytes, where repeated scans would be quadratic, go through a heap over linked parts that merges in the same order.

Defined results: a null text is empty (no ids, empty decoded text); repeated rows and null ids are kept as they are;
strings of special tokens in a text become those tokens; bytes that are not UTF-8 after decoding become U+FFFD; an empty
table gives no rows; other columns are ignored. Texts are encoded whole, one at a time beyond ``PIECE_BYTES``: a worker
holds about 40 bytes for each byte of the longest.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import pieces
from siftlake.llm.tokens import BYTE_CHUNKS, ChunkCache, byte_characters

SHORT = 128
NONE = 1 << 60
#: Fixed value: the byte-level pattern of the tokenizer file's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """A byte-level BPE model read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.single = [vocab.get(c) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id << 20 | right id) to (rank << 20 | merged id)
        self.merge = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.latin = regex.compile("[\\u0000-\\u024f]*").fullmatch
        self.latin_words = regex.compile(PATTERN).findall
        self.path, self.alphabet, self.pretokenizer = path, alphabet, None
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}
        self.chunked = ChunkCache(BYTE_CHUNKS, lambda _, chunk: self._chunk(chunk), [*self.specials], self._whole, len(self.bytes_of) - 1)

    def _short(self, ids: list[int]) -> list[int]:
        merge = self.merge
        ranks = [merge.get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge.get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = merge.get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, merge = len(ids), self.merge
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = m & 0xFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merge.get(ids[x] << 20 | ids[y], NONE)) != NONE:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if alive[i]]

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            raw = word.encode()
            ids = [self.single[b] for b in raw]
            ids = self._short(ids) if len(ids) <= SHORT else self._long(ids)
            found = np.array(ids, "<u4").tobytes()
            if len(raw) <= SHORT:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk; beyond Latin letters by the library's own pattern, whose Unicode tables are older."""
        if self.latin(chunk):
            return self.latin_words(chunk)
        if self.pretokenizer is None:
            from tokenizers import Tokenizer

            self.pretokenizer = Tokenizer.from_file(self.path).pre_tokenizer
        cut = self.pretokenizer.pre_tokenize_str(chunk)
        return [bytes(self.alphabet[c] for c in mapped).decode() for mapped, _ in cut]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, self.words(chunk)))

    def _whole(self, text: str) -> bytes:
        """A text that holds special tokens: each stretch between them is a text of its own."""
        end = {k: np.array([v], "<u4").tobytes() for k, v in self.specials.items()}
        return b"".join(end[part] if part in end else self._chunk(part) for part in self.special_split.split(text) if part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunked(texts)

    def decode(self, ids: bytes) -> str:
        """The text of such ids, special tokens included."""
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` with the ids of every whole text as ``array<int>``."""

    def run(batches):
        for batch in pieces(batches):
            ids = [np.frombuffer(x, "<i4") for x in model(path).encode(batch["text"].to_pylist())]
            flat = np.concatenate([np.empty(0, "<i4"), *ids])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and decoded again, in one narrow pass."""

    def run(batches):
        bpe = model(path)
        for batch in pieces(batches):
            n, ids_sha, text_sha = [], [], []
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 256):
                for ids in bpe.encode(texts[at : at + 256]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            arrays = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
