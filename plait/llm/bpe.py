"""BPE encoding and decoding over a contiguous rank array.

A word's parts and the ranks of adjacent pairs stand in two parallel arrays. The smallest rank is
found by scanning, its right part is deleted, and the ranks at both sides are refreshed, until no
pair has a rank. Words are short, so scanning a small contiguous array beats a heap; words above
``LONG`` parts use a heap over linked parts that merges in the same order (rank, then position).

The vocabulary file decides the rest: special tokens are cut from the raw text, the text between is
NFC-normalised, white-space runs become one space, letters are lower-cased, words are split by a
pattern, their bytes are written as letters of the byte alphabet, and the last one bears ``</w>``. A file
that asks for other steps is refused. Which characters are letters, and what they are in lower case,
depends on the Unicode version: texts with characters outside blocks that have been full for long are
normalised and split into words by the library's own steps, read from the file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, ship

LONG = 64
#: Words whose encoding a worker remembers; the memory is dropped when full.
REMEMBERED = 150_000
NONE = 1 << 60
# fixed values: blocks whose letters, numbers and cases no later Unicode version has changed
_LATE = re.compile("[^\u0000-\u024f\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]")
# fixed values: the steps before the merges that are built here
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("this vocabulary uses BPE options that are not supported")
        normalizer, splits = spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"]
        split = splits[0]
        if normalizer.get("normalizers") != _STEPS or [p["type"] for p in splits] != ["Split", "ByteLevel"] or split["behavior"] != "Removed" or not split["invert"] or splits[1]["add_prefix_space"] or splits[1]["use_regex"]:
            raise ValueError("this vocabulary asks for steps that are not supported")
        self.library_normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.library_words = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior="removed", invert=True).pre_tokenize_str
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        # white space as the library's pattern engine has it: Unicode's White_Space
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Part ids of one word → token ids."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs = self.pairs
        got = [pairs.get(p) for p in zip(ids, ids[1:])]
        ranks = [g[0] if g else NONE for g in got]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = pairs[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                g = pairs.get((ids[i], ids[i + 1]))
                ranks[i] = g[0] if g else NONE
            if i:
                g = pairs.get((ids[i - 1], ids[i]))
                ranks[i - 1] = g[0] if g else NONE
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = pairs[a, b][1]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], h, *p))
        return [x for x, live in zip(ids, alive) if live]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.merge(ids)

    def _entry(self, word: str) -> tuple[int, bytes, bytes]:
        ids = self.encode_word(word)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        names = self.names
        entry = len(ids), " ".join(map(str, ids)).encode(), " ".join([names[i] for i in ids]).encode()
        if len(word) <= LONG:
            self.known[word] = entry
        return entry

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # letter by letter: a sigma at a word's end has no form of its own
            return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return text.lower()

    def words_of(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if _LATE.search(text):
            return [w for w, _ in self.library_words(self.library_normal(text))]
        return self.words.findall(self.normal(text))

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.cut is None or "<|" not in text and not any(s in text for s in self.special):
            yield text, False
            return
        for i, part in enumerate(self.cut.split(text)):
            if part:
                yield part, i % 2 == 1

    def digest(self, text: str) -> tuple[int, str, str]:
        """(tokens, sha256 of the ids in decimal joined by spaces, sha256 of the decoded text)."""
        n, ids, words = 0, [], []
        known, entry = self.known, self._entry
        for part, special in self._segments(text):
            if special:
                got = [(1, str(self.special[part]).encode(), part.encode())]
            else:
                got = [known.get(w) or entry(w) for w in self.words_of(part)]
            if got:
                counts, a, b = zip(*got)
                n += sum(counts)
                ids += a
                words += b
        sha = lambda x: hashlib.sha256(b" ".join(x)).hexdigest()
        return n, sha(ids), sha(words)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self._segments(text):
            if special:
                out.append(self.special[part])
            else:
                for w in self.words_of(part):
                    out += self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without a decoder: token strings joined by a space;
        ids outside the vocabulary are dropped."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_digests(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text with the vocabulary at ``path`` (the same on every node).

    Returns ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row per input row. A null text
    counts as empty: no tokens, digests of the empty string. Null ids and repeated rows stay; other
    columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            got = [bpe.digest(t or "") for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text, for use outside digests."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")
