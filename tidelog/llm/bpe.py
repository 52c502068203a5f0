"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

A word is held as a contiguous array of part boundaries beside an array of the ranks of adjacent
parts. The smallest rank is found by a scan, the boundary between its two parts is deleted and the
ranks on either side are looked up again. Words above SCAN_LIMIT parts keep the same arrays as a
linked list under a heap, so that a text without spaces doesn't cost the square of its length.

Defined results: a null or empty text encodes to no ids and decodes to the empty string; repeated
rows give repeated rows; empty tables give empty results; texts of any length are encoded whole, one
at a time; of pairs that tie in rank the leftmost is joined first; other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Words of more parts than this use the heap.
SCAN_LIMIT = 256
#: Distinct words whose ids are kept in a worker, twice: a full table is kept until the next is full,
#: and words that are met again move on from it.
CACHE_WORDS = 120_000
#: Text that is encoded at a time in a worker: ids take ten times as much memory as their text.
_SLICE_BYTES = 1 << 20
_FAR = 1 << 60

# The vocabulary's library splits by Unicode 16.0 and lowers letters by 17.0; Python knows 15.1.
#: Letters and numbers that Unicode 16.0 added, in hexadecimal.
_NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 "
    "113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
_NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capitals that 16.0 and 17.0 added.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}
# letters by themselves, so that the last sigma of a word is like any other
_LOWER = _NEW_LOWER | {ord("Σ"): ord("σ")}
_ODD_CAPITALS = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def _ranges(category: str, added: str) -> str:
    """A character class's content: all of a category, with what was added to it."""
    out, first = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == category
        if inside and first is None:
            first = i
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{i - 1:08x}")
            first = None
    for r in added.split():
        low, _, high = r.partition("-")
        out.append(f"\\U{int(low, 16):08x}-\\U{int(high or low, 16):08x}")
    return "".join(out)


_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in plain else extra)
        extra += b not in plain
    return out


class BpeTokenizer:
    """Encodes and decodes as the vocabulary file says; word-end vocabularies only."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: The rank of a pair of ids, as one number, and the id that a rank's merge makes.
        self.ranks = {self.vocab[x] << 32 | self.vocab[y]: r for r, (x, y) in enumerate(merges)}
        self.made = [self.vocab[x + y] for x, y in merges]
        self.alphabet = byte_alphabet()
        steps = [spec["normalizer"]] if "normalizers" not in spec["normalizer"] else spec["normalizer"]["normalizers"]
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.form = next((s["type"] for s in steps if s["type"] in ("NFC", "NFKC", "NFD", "NFKD")), None)
        pre = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split")
        pattern = pattern.replace(r"\s", _WHITE)  # it stands in a class; Python's \s has four separators more
        self.split = re.compile(pattern.replace(r"\p{L}", _ranges("L", _NEW_LETTERS)).replace(r"\p{N}", _ranges("N", _NEW_NUMBERS)))
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.byte_ids = [self.vocab[c] for c in self.alphabet]
        self.last_ids = [self.vocab[c + self.suffix] for c in self.alphabet]
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.former: dict[str, tuple[int, str, str]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """The ids of a word after all merges, lowest rank first, leftmost of equal ranks."""
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        get, made = self.ranks.get, self.made
        ranks = [get(x << 32 | y, _FAR) for x, y in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _FAR:
                break
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, _FAR)
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], _FAR)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = self.made[rank], False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := get(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        return self.merge([*(self.byte_ids[b] for b in data[:-1]), self.last_ids[data[-1]]])

    def _entry(self, chunk: str) -> tuple[int, str, str]:
        """For a run without white space: count of ids, the ids and the tokens joined by a space."""
        out = self.cache.get(chunk) or self.former.get(chunk)
        if out is None:
            words = (chunk,) if chunk.isalpha() else self.split.findall(chunk)
            if len(words) == 1 and words[0] == chunk:
                ids, tokens = self.word(chunk), self.tokens
                out = (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
            else:
                parts = [self.cache.get(w) or self._entry(w) for w in words]
                out = (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        if len(self.cache) >= CACHE_WORDS:
            self.former, self.cache = self.cache, {}
        self.cache[chunk] = out
        return out

    def _found(self, text: str) -> list[tuple[int, str, str]]:
        if self.form:
            text = unicodedata.normalize(self.form, text)
        if self.lower:
            text = (text if text.isascii() or not _ODD_CAPITALS.search(text) else text.translate(_LOWER)).lower()
        # str.split also splits at four separators that aren't white space to the pattern
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else filter(None, re.split(f"[{_WHITE}]+", text))
        get, entry = self.cache.get, self._entry
        return [get(chunk) or entry(chunk) for chunk in chunks]

    def joined(self, text: str | None) -> tuple[int, str, str]:
        """Of a whole text: the count of ids, the ids joined by a space, and what they decode to."""
        found: list[tuple[int, str, str]] = []
        for part in self.at_special.split(text or "") if "<|" in (text or "") else [text or ""]:
            if part in self.special:
                found.append((1, str(self.special[part]), part))
            elif part:
                found += self._found(part)
        counts, ids, tokens = zip(*found) if found else ((), (), ())
        return sum(counts), " ".join(ids), " ".join(tokens)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.joined(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space: these vocabularies have no decoder of their own."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_tokenizers: dict[str, BpeTokenizer] = {}


def tokenizer(path: str) -> BpeTokenizer:
    """One for each worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = BpeTokenizer(path)
    return _tokenizers[path]


def _full(n: int, ids: str, decoded: str) -> tuple:
    return n, np.fromstring(ids, np.int32, sep=" "), decoded


def _digest(n: int, ids: str, decoded: str) -> tuple:
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return n, sha(ids), sha(decoded)


def _ids(n: int, ids: str, decoded: str) -> tuple:
    return n, np.fromstring(ids, np.int32, sep=" "), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


IDS = (_ids, "n_tokens long, ids array<int>, decoded_sha256 string", [pa.int64(), pa.list_(pa.int32()), pa.string()])
FULL = (_full, "n_tokens long, ids array<int>, decoded string", [pa.int64(), pa.list_(pa.int32()), pa.string()])
DIGEST = (_digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", form: tuple[Callable, str, list] = FULL) -> DataFrame:
    """Each row's key with the ids of its whole text and what they decode to (FULL, or IDS with a digest
    of the latter), or digests of both (DIGEST)."""
    finish, ddl, types = form
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        t = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, text, _SLICE_BYTES):
                rows = [finish(*t.joined(x)) for x in batch.column(1).to_pylist()]
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {ddl}")
