"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is then
parsed greedily against each automaton: a phrase is the longest match from where the last one ended
that occurs in the language's sample (a letter that occurs nowhere is a phrase of its own). The
number of phrases, normalised by the logarithm of the sample's length, estimates the cross entropy;
the language with the smallest estimate wins.

Parsing runs over all languages and many texts at once: normalised texts are cut in blocks of
BLOCK letters, each parsed from the automaton's root, and NumPy steps all blocks together. Blocks are
then parsed again from the state in which the block before ended, up to where both parses meet, until
none changes. So phrases go over the cuts, as in one parse of the whole text; none is sampled.

Defined results: null texts and texts without a letter are UNKNOWN with score 0; ties go to the
alphabetically first language; repeated rows give repeated rows; without any labelled text every
row is UNKNOWN; empty tables give empty results. Null ids are predicted like others and are never held out. Every language that some
row with a letter is labelled with is learnt, however short its texts; longer rows are taken first.
A letter that a language's sample lacks costs as much as a phrase of the largest sample, so small
samples aren't cheap for texts in other letters. Texts of any length are parsed whole, in pieces that go
on from one another. Columns besides doc_id, text and lang aren't read, and accepted() keeps them whatever
their names.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, trim, utf8_buffer

#: The bound of the labelled sample: rows per language, and letters per language.
SAMPLE_ROWS = 40
SAMPLE_LETTERS = 30_000
#: Letters that are parsed side by side with those of other blocks. Phrases and languages don't depend on
#: it; of texts that change language, accepted() takes each block in its nearest.
BLOCK = 256
#: How often a second parse looks whether it has met the first.
_MEET = 16
#: Letters, the commonest, that have a column in the table of transitions. Those by all others are
#: looked up by state and letter, so alphabets of any size are told apart.
LETTERS = 60
UNKNOWN = "und"
#: A text is in a language if its estimate in bits a letter is below so many times what one half of the
#: language's sample has under the other; half way to one phrase a letter at most.
MAX_RATIO = 1.5
#: The least limit, as a share of one phrase a letter: for samples that repeat themselves.
MIN_SHARE = 0.3
#: By so many standard deviations of the number of phrases may short texts be above the limit.
DEVIATIONS = 2.0
#: Above the state: how many phrases end with a step, up to 2.
_ENDS = 29
_MISS = np.int32(1 << _ENDS)
_PAD, _SPACE, _OTHER = 0, 1, 2
#: Text that is parsed at a time in a worker: some 20 times as much memory. Longer texts are parsed in
#: pieces of that size, cut between characters, each from the state in which the one before ended.
_SLICE_BYTES = 2 << 20


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads every substring of codes."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(to)
        length.append(length[last] + 1)
        link.append(0)
        to.append({})
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                length.append(length[p] + 1)
                link.append(link[q])
                to.append(dict(to[q]))
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


def _letter_table() -> np.ndarray:
    """For each code point: its lower case if it's a letter, else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for lo, hi in ((0, 0x3400), (0xA000, 0xB000), (0xF900, 0x10000), (0x10000, 0x1F000)):
        for i in range(lo, hi):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):
        out[lo:hi] = np.arange(lo, hi)
    return out


_tables: dict[str, np.ndarray] = {}


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case; everything else is a space."""
    if "letters" not in _tables:
        _tables["letters"] = _letter_table()
    return _tables["letters"][points]


@dataclass
class Model:
    """langs in order; step[state * width + code] holds the next state, with a multiple of _MISS where phrases end.

    Codes from width on have no column: rare holds state * letters + code of each transition by them, in
    order, and rare_to the states that they lead to.
    """

    langs: list[str]
    codes: np.ndarray
    width: int
    step: np.ndarray
    rare: np.ndarray
    rare_to: np.ndarray
    root: np.ndarray
    bits: np.ndarray
    lacks: np.ndarray
    """lacks[lang, code]: whether the language's sample lacks the letter."""
    limits: np.ndarray
    """Bits a letter up to which a long text is in the language."""

    @staticmethod
    def fit(samples: dict[str, list[str]], letters: int = SAMPLE_LETTERS, calibrated: bool = True) -> Model:
        """samples: some texts of each language; the first `letters` normalised letters are used."""
        texts = {}
        for lang in sorted(samples):
            points = folded(code_points(" ".join(samples[lang]).encode("utf-8")))
            keep = (points != 32) | np.r_[True, points[:-1] != 32]
            if (points[keep][:letters] != 32).any():
                texts[lang] = points[keep][:letters]
        langs = list(texts)
        seen, counts = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]), return_counts=True)
        known = [int(c) for c in seen[np.argsort(-counts, kind="stable")] if c != 32]
        codes = np.full(sys.maxunicode + 1, _OTHER, np.int32)
        codes[32] = _SPACE
        for i, c in enumerate(known):
            codes[c] = i + 3
        n_codes, width = len(known) + 3, min(len(known), LETTERS) + 3
        # an automaton has fewer than twice as many states as letters; pages that stay unused take no memory
        step = np.empty((sum(2 * len(t) + 1 for t in texts.values()), width), np.int32)
        roots, base, rare = [], 0, {}
        for lang in langs:
            to = suffix_automaton(codes[texts[lang]].tolist())
            table = step[base : base + len(to)]
            table[:] = -1
            for state, edges in enumerate(to):
                for c, nxt in edges.items():
                    if c < width:
                        table[state, c] = nxt + base
                    else:
                        rare[(state + base) * n_codes + c] = nxt + base
            # a new phrase starts with the letter that didn't fit, or is that letter alone
            again = np.where(table[0] >= 0, table[0] | _MISS, np.int32(base | 2 * int(_MISS)))
            alone = np.where(table[0] >= 0, table[0], np.int32(base | int(_MISS)))
            for i in range(width):
                column = table[:, i]
                column[column < 0] = again[i]
            table[0] = alone
            table[:, _PAD] = base | int(_MISS)
            table[0, _PAD] = base
            roots.append(base)
            base += len(to)
            del to
        bits = np.array([np.log2(max(2, len(texts[lang]))) for lang in langs])
        step = step[:base].reshape(-1)
        lacks = np.array([~np.isin(np.arange(n_codes), codes[texts[lang]]) for lang in langs]).reshape(len(langs), n_codes)
        lacks[:, [_PAD, _SPACE]], lacks[:, _OTHER] = False, True
        keys = np.array(sorted(rare), np.int64)
        rare_to = np.array([rare[k] for k in keys.tolist()], np.int32)
        limits = np.array([_limit(texts[lang], b) for lang, b in zip(langs, bits)]) if calibrated else bits
        return Model(langs, codes, width, step, keys, rare_to, np.array(roots, np.int32), bits, lacks, limits)

    def _step(self, state: np.ndarray, root: np.ndarray, codes: np.ndarray, any_rare: bool) -> np.ndarray:
        """Next states, with how many phrases end, by the codes of the last axis."""
        width = np.int32(self.width)
        if not any_rare or not len(seldom := np.flatnonzero(codes >= width)):
            return self.step[state * width + codes]
        nxt = self.step[state * width + np.where(codes < width, codes, _OTHER)]
        # letters without a column: as for the others, a new phrase starts with the letter that didn't
        # fit, or is that letter alone
        now, by = codes[seldom], state[..., seldom]
        found = self.step[by * width + _OTHER]
        for start, ends in ((np.broadcast_to(root, state.shape)[..., seldom], _MISS), (by, np.int32(0))):
            keys = start.astype(np.int64) * self.lacks.shape[1] + now
            at = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            found = np.where(self.rare[at] == keys, self.rare_to[at] | ends, found)
        nxt[..., seldom] = found
        return nxt

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text under each language, and letters of each text."""
        return self._parsed(data, offsets)[:2]

    def _parsed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """As phrases(); how many letters of each text each language's sample lacks; and the bits of each
        text if each block is in its nearest language."""
        if len(offsets) == 2 and len(data) > _SLICE_BYTES:
            cuts = np.arange(0, len(data), _SLICE_BYTES)
            while (inside := (data[cuts] & 0xC0) == 0x80).any():
                cuts = cuts - inside
            total, carried = None, None
            for s, e in zip(cuts, [*cuts[1:], len(data)]):
                found, carried = self._phrases(data[s:e], np.array([0, e - s]), carried, e == len(data))
                total = found if total is None else tuple(x + y for x, y in zip(total, found))
            return total
        return self._phrases(data, offsets)[0]

    def _phrases(self, data: np.ndarray, offsets: np.ndarray, carried=None, ends: bool = True):
        """What _parsed gives of some texts, and what one that goes on carries to its next piece: the
        states it ends in and whether a space was last."""
        n, n_langs = len(offsets) - 1, len(self.langs)
        points = code_points(data.tobytes())
        # where texts begin among the code points: bytes that don't continue one
        at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        low = folded(points)
        space = low == 32
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        starts = np.zeros(len(low) + 1, bool)
        starts[at] = True
        keep &= ~(space & starts[:-1])
        if carried and len(space) and space[0]:
            keep[0] = not carried[1]
        is_letter = np.r_[0, np.cumsum(~space)]
        letters = is_letter[at[1:]] - is_letter[at[:-1]]
        kept_at = np.r_[0, np.cumsum(keep)][at]
        codes = self.codes[low[keep]]
        lens = np.diff(kept_at)
        blocks = -(-lens // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        total = int(blocks.sum())
        counts, lacking = np.zeros((2, n_langs, n), np.int64)
        if total == 0 or not n_langs:
            if carried and ends:
                counts += (carried[0] != self.root)[:, None]
            return (counts, letters, lacking, np.zeros(n)), carried
        within = np.arange(total) - np.r_[0, np.cumsum(blocks)][:-1][owner]
        begin = kept_at[:-1][owner] + within * BLOCK
        size = np.minimum(BLOCK, lens[owner] - within * BLOCK)
        by_size = np.argsort(-size, kind="stable")
        place = np.empty(total, np.int64)
        place[by_size] = np.arange(total)
        # from here on blocks go from the longest to the shortest; the place of the next in the text, or -1
        after = np.where(np.r_[within[1:] > 0, False], np.r_[place[1:], -1], -1)[by_size]
        begin, size, owner, first = begin[by_size], size[by_size], owner[by_size], (within == 0)[by_size]
        root = self.root[:, None]
        state = np.repeat(root, total, 1)
        if carried:
            state[:, first] = carried[0][:, None]
        began = state.copy()
        any_rare = bool((codes >= self.width).any())
        count = np.zeros((n_langs, total), np.int32)
        met: list[tuple[np.ndarray, np.ndarray]] = []  # states and counts after every _MEET letters
        active = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks longer than j
        for j in range(int(size[0])):
            m = int(active[j])
            nxt = self._step(state[:, :m], root, codes[begin[:m] + j], any_rare)
            count[:, :m] += nxt >> _ENDS
            state[:, :m] = nxt & (_MISS - 1)
            if j % _MEET == _MEET - 1:
                met.append((state.copy(), count.copy()))
        changed = np.arange(total)
        while len(changed := changed[after[changed] >= 0]):
            lang, block = np.nonzero(state[:, changed] != began[:, after[changed]])
            now_began, block = state[lang, changed[block]], after[changed[block]]
            began[lang, block] = now_began
            before = state[lang, block]
            self._parse_again(lang, block, now_began, begin, size, codes, state, count, met, any_rare)
            changed = np.unique(block[state[lang, block] != before])
        last = (after < 0) & ends
        count += (state != root) & last
        cost = count * self.bits[:, None]
        for i in range(n_langs):
            counts[i] = np.bincount(owner, count[i], n)
            if np.ptp(self.bits):  # else they cost what other phrases cost
                lacks = np.r_[0, np.cumsum(self.lacks[i][codes])]
                lacking[i] = np.diff(lacks[kept_at])
                cost[i] += (lacks[begin + size] - lacks[begin]) * (self.bits.max() - self.bits[i])
        return (counts, letters, lacking, np.bincount(owner, cost.min(0), n)), (state[:, np.flatnonzero(after < 0)[-1]], bool(space[-1]))

    def _parse_again(self, lang, block, now, begin, size, codes, state, count, met, any_rare) -> None:
        """Parses blocks under languages from other states, up to where the parse meets the one before."""
        n = np.zeros(len(lang), np.int32)
        for j in range(BLOCK):
            over = size[block] <= j
            if over.any():
                state[lang[over], block[over]], count[lang[over], block[over]] = now[over], n[over]
                lang, block, now, n = lang[~over], block[~over], now[~over], n[~over]
            if not len(lang):
                return
            nxt = self._step(now, self.root[lang], codes[begin[block] + j], any_rare)
            n, now = n + (nxt >> _ENDS), nxt & (_MISS - 1)
            if j % _MEET == _MEET - 1:
                k = j // _MEET
                same = met[k][0][lang, block] == now
                for later in [c for _, c in met[k + 1 :]] + [count]:
                    later[lang[same], block[same]] += (n - met[k][1][lang, block])[same]
                met[k][0][lang, block], met[k][1][lang, block] = now, n
                lang, block, now, n = lang[~same], block[~same], now[~same], n[~same]
        state[lang, block], count[lang, block] = now, n

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the language, a score from 0 to 1, the entropy estimate in bits a letter, and
        whether it is, block by block in the nearest language, within what texts in the language have.

        The score is 1 less the ratio of the best estimate to the second best's, or to one phrase
        a letter where only one language is known.
        """
        counts, letters, lacking, mixed = self._parsed(data, offsets)
        if not self.langs:
            return [UNKNOWN] * len(letters), np.zeros(len(letters)), np.zeros(len(letters)), np.zeros(len(letters), bool)
        cost = counts * self.bits[:, None] + lacking * (self.bits.max() - self.bits)[:, None]
        best = np.argmin(cost, 0)
        ordered = np.sort(cost, 0)
        second = ordered[1] if len(self.langs) > 1 else letters * self.bits[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.clip(np.nan_to_num(1 - ordered[0] / second), 0, 1)
            # without the last phrase, which the end of the text cuts off
            rate = np.nan_to_num(np.maximum(0, ordered[0] - self.bits[best]) / letters)
            limit, bits = self.limits[best], self.bits[best]
            # texts that change between known languages are in a known language
            least = np.nan_to_num(np.maximum(0, mixed - bits) / letters)
            known = ~(least > np.minimum(limit + DEVIATIONS * np.sqrt(limit * bits / letters), (limit + bits) / 2))
        none = letters == 0
        score[none], rate[none] = 0, 0
        return [UNKNOWN if x else self.langs[b] for x, b in zip(none, best)], score, rate, known & ~none


def _limit(sample: np.ndarray, bits: float) -> float:
    """Of a language's normalised sample: the limit by how well its halves foretell each other."""
    halves = [points.astype("<u4").tobytes().decode("utf-32-le") for points in (sample[: len(sample) // 2], sample[len(sample) // 2 :])]
    rates = []
    for learnt, other in (halves, halves[::-1]):
        data = np.frombuffer(other.encode("utf-8"), np.uint8)
        rates.append(Model.fit({"": [learnt]}, len(sample), False).predict(data, np.array([0, len(data)]))[2][0] if learnt.strip() and other.strip() else bits)
    own = float(np.mean(rates))
    return max(MIN_SHARE * bits, min(MAX_RATIO * own, (own + bits) / 2))


def held_out(doc_id):
    """True for rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, letters: int = SAMPLE_LETTERS) -> DataFrame:
    """At most `rows` texts of each language, of rows that aren't held out, chosen by a hash of the id.

    Rows of 200 characters or more come first, then the longest. Texts count from their first letter on.
    The ranking is cut in each task before the shuffle, so no language is gathered anywhere.
    """
    learn = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    learn = learn.withColumn("size", F.least(F.length("text"), F.lit(200))).withColumn("text", F.regexp_replace("text", r"^\P{L}++", ""))
    order = Window.partitionBy("lang").orderBy(F.desc("size"), F.xxhash64("doc_id"), "doc_id", "text")
    most = -(-2 * letters // rows)  # twice the share of a row: some rows are shorter than that
    part = learn.select("lang", "doc_id", "size", F.substring("text", 1, most).alias("text"))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).orderBy("lang", "rank")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, letters: int = SAMPLE_LETTERS) -> Model:
    """Learns from a bounded sample: `rows` rows and `letters` letters a language come to the driver."""
    samples: dict[str, list[str]] = {}
    for r in labelled_sample(docs, rows, letters).select("lang", "text").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return Model.fit(samples, letters)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits a letter of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's parameters

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", _SLICE_BYTES):
                langs, score, rate, _ = shared.value.predict(*utf8_buffer(batch.column("text")))
                cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(rate)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "bits_per_letter"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_letter double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in some known language; a null lang
    becomes the predicted one. Texts without a letter go, and texts whose blocks, each in its nearest
    language, cost more than the sample of the text's language shows of its own; short texts have more room."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a mapping reads columns by names that need no quotes
    names = [c if c in ("text", "lang") else f"other_{i}" for i, c in enumerate(docs.columns)]
    given = docs.schema.names

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", _SLICE_BYTES):
                langs, _, _, known = shared.value.predict(*utf8_buffer(batch.column("text")))
                keep = pa.array(known)
                cols = {n: batch.column(n) for n in names}
                cols["lang"] = pa.array([a if a is not None else b for a, b in zip(cols["lang"].to_pylist(), langs)], pa.string())
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=given).filter(keep)
        trim()

    return docs.toDF(*names).mapInArrow(run, docs.schema)
