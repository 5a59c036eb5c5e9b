r"""BPE encoding and decoding by speculation and verification.

A text is normalised and split into words as the vocabulary file says (NFC,
white space to blanks, lower case; contractions, runs of letters, single digits
and runs of other signs). A word is bytes whose last symbol carries the end-of-word
mark. Greedy longest match proposes its tokens. Byte-pair merging gives exactly
these tokens if every proposed token is what merging makes of its own bytes
and no merge happens across any border of two neighbours, which a vectorised
check tests for all borders of a batch of words at once: for each pair of
symbols that stand at a border at one time (the right spine of the left token's
merge tree against the left spine of the right one's) it looks up whether a
merge of the two comes before either is taken up by its own token. Words that
fail are merged exactly: short ones many at a time in a matrix of bounded size,
long ones by a heap of their pairs, so that the time grows with a word's length by n log n.
Results are remembered for a bounded number of words.

Texts are encoded whole, in pieces of about PIECE signs that end before white space,
where no word can run on: a long text takes the memory of a piece, its own and that of its
output (with digests, a digest only).

Defined cases: a null or empty text has no tokens; special tokens in a text are
their own ids, as in the public library; repeated rows are encoded each; of equal ranks the
leftmost pair merges first; an empty table gives no rows; input columns named as a
result, in any case, are replaced, all others are kept.
"""

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from adit.llm import kernels

#: Words that a worker remembers, in two generations: those met since the last change of generation, and those of the one before.
MEMORY = 200_000
#: Longer words are not remembered beyond the texts at hand.
LONG = 64
#: Signs of a piece of text, and cells of a matrix of words that are merged at once.
PIECE, CELLS = 1 << 17, 1 << 18
NEVER = np.int64(1) << 40
_WHITE = re.compile("[ \t\r\n]")
#: Marks special tokens among words; no text of UTF-8 holds this character.
SPECIAL = "\ud800"


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class _PairTable:
    """Ranks and results of merges, looked up for arrays of pairs: hashing into two tables."""

    def __init__(self, codes: np.ndarray, ranks: np.ndarray):
        self.codes, self.ranks = codes, ranks
        self.mult, self.slots = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), []
        left = np.arange(len(codes))
        for m in self.mult:
            slot = np.full(1 << 20, -1, np.int64)
            at = self._slot(codes[left], m)
            slot[at] = left  # one of those that meet in a slot stays
            self.slots.append(slot)
            left = left[slot[at] != left]
        self.more = {int(codes[i]): i for i in left}  # hardly ever any

    @staticmethod
    def _slot(code: np.ndarray, mult: np.uint64) -> np.ndarray:
        return ((code.astype(np.uint64) * mult) >> np.uint64(44)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, result) of merging a and b; NEVER and -1 where they don't merge."""
        code = np.where((a >= 0) & (b >= 0), (a.astype(np.int64) << 32) | b, -1)
        at = np.full(code.shape, -1, np.int64)
        for m, slot in zip(self.mult, self.slots):
            k = slot[self._slot(code, m)]
            at = np.where((k >= 0) & (self.codes[k] == code), k, at)
        for c, i in self.more.items():
            at[code == c] = i
        return np.where(at >= 0, self.ranks[at, 0], NEVER), np.where(at >= 0, self.ranks[at, 1], -1)


class Tokenizer:
    """The encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        size = max(self.vocab.values()) + 1
        self.tokens = [""] * size
        for t, i in self.vocab.items():
            self.tokens[i] = t
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.full(size, -1), np.full(size, -1)
        made = np.full(size, -1)  # rank of the merge that forms a token; -1 for symbols
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            c = self.vocab[a + b]
            a, b = self.vocab[a], self.vocab[b]
            self.rank.setdefault((a, b), (r, c))
            if made[c] < 0:
                made[c], left[c], right[c] = r, a, b
        self.pairs = _PairTable(np.array([(a << 32) | b for a, b in self.rank], np.int64), np.array(list(self.rank.values()), np.int64))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t, i in self.special.items():
            if i >= len(self.tokens):
                self.tokens += [""] * (i + 1 - len(self.tokens))
            self.tokens[i] = t
        self.special_cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # white space need only become blanks where a word may hold some
        self.blank = regex.compile(r"\p{White_Space}+") if " " in pattern or r"\s" in pattern.replace(r"[^\s", "") else None
        self.sign = _byte_signs()
        self.names = [str(i) for i in range(len(self.tokens))]
        # tokens that may end a word, by their text without the mark, and those that may stand before; the latter's greatest length by their first three signs
        ending = {t: i for t, i in self.vocab.items() if t.endswith(self.suffix)}
        self.ends = {t.removesuffix(self.suffix): i for t, i in ending.items() if t != self.suffix}
        self.longest = max(map(len, self.ends), default=0)
        self.inner = {t: i for t, i in self.vocab.items() if not self.suffix or t not in ending}
        self.reach: dict[str, int] = {}
        for t in self.inner:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 2))
        # spines: the symbols at a token's edge, from the whole token down, and the rank at which each is taken up
        self.right_spine, self.right_end = self._spine(right, made)
        self.left_spine, self.left_end = self._spine(left, made)
        alone = self._exact([[self.vocab[s] for s in self._symbols(t)] if t in self.vocab else [] for t in self.tokens])
        self.own = np.array([ids == [i] for i, ids in enumerate(alone)])
        # what is known of a word, or of a marked special token: its ids and its tokens, each joined by blanks
        self.ids = {SPECIAL + t: str(i) for t, i in self.special.items()}
        self.shown = {SPECIAL + t: t for t in self.special}
        self.old_ids, self.old_shown = {}, {}
        self.fixed = set(self.ids)

    def _symbols(self, token: str) -> list[str]:
        """The symbols that a token's text starts as."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix] if body else [token]
        return list(token)

    @staticmethod
    def _spine(child: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, end = np.arange(len(child)), np.full(len(child), NEVER)
        nodes, ends = [], []
        while (at >= 0).any():
            nodes.append(at)
            ends.append(end)
            end = np.where(at >= 0, made[np.maximum(at, 0)], -1)
            at = np.where(at >= 0, child[np.maximum(at, 0)], -1)
        return np.array(nodes), np.array(ends)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the bytes of tokens a and b does not cross their border.

        At equal ranks the leftmost merge goes first: a symbol of the left
        token is then taken up by its own token first, one of the right token is not.
        """
        ok = np.ones(len(a), bool)
        for x, xe in zip(self.right_spine[:, a], self.right_end[:, a]):
            for y, ye in zip(self.left_spine[:, b], self.left_end[:, b]):
                k = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(k):
                    continue
                r, _ = self.pairs.find(x[k], y[k])
                ok[k[(r < xe[k]) & (r <= ye[k])]] = False
        return ok

    def _merged(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging of one word of any length: a heap of pairs over linked symbols."""
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, k, a, b = heapq.heappop(heap)
            m = after[k]
            if m >= n or ids[k] != a or ids[m] != b:
                continue  # one of the two has been merged since
            ids[k], ids[m], after[k] = made, -1, after[m]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (r := rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (*r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def _exact(self, words: list[list[int]]) -> list[list[int]]:
        """Plain byte-pair merging of many words: in each, the lowest rank first, leftmost among equals."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > LONG):
            out[i] = self._merged(list(words[i]))
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG]
        for some in np.array_split(order, max(1, -(-len(order) * (LONG + 1) // CELLS))):  # of like length
            n, most = len(some), int(size[some].max(initial=0))
            at = np.full((n, most + 1), -1, np.int64)
            for k, i in enumerate(some):
                at[k, : size[i]] = words[i]
            rank, into = self.pairs.find(at[:, :-1], at[:, 1:])
            row, place = np.arange(n), np.arange(most)[None, :]
            while len(row):
                best = rank.argmin(1)
                here = np.arange(len(row))
                going = rank[here, best] < NEVER
                if not going.all():
                    for k in np.flatnonzero(~going):
                        out[some[row[k]]] = at[k][at[k] >= 0].tolist()
                    at, rank, into, row, best = at[going], rank[going], into[going], row[going], best[going]
                    here = here[: len(row)]
                    if not len(row):
                        break
                at[here, best] = into[here, best]
                # close the gap that the right symbol leaves
                src = np.minimum(place + (place > best[:, None]), most)
                at[:, :-1] = np.take_along_axis(at, src, 1)
                at[:, -1] = -1
                src = np.minimum(place + (place > best[:, None]), most - 1)
                rank, into = np.take_along_axis(rank, src, 1), np.take_along_axis(into, src, 1)
                for side in (0, -1):
                    c = np.maximum(best + side, 0)
                    rank[here, c], into[here, c] = self.pairs.find(at[here, c], at[here, c + 1])
                if most > 1:
                    rank[at[:, 1:] < 0] = NEVER
        return out

    def _greedy(self, word: str) -> list[int]:
        """Longest matches from the left; the last one carries the end-of-word mark."""
        ends, inner, reach, out, i, n, longest = self.ends, self.inner, self.reach, [], 0, len(word), self.longest
        while i < n:
            if n - i <= longest and (t := ends.get(word[i:])) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach.get(word[i : i + 3], 2)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"the vocabulary lacks {word[i]!r}")
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that are not yet known."""
        sign = self.sign
        signed = [w if w.isascii() and w.isprintable() else "".join([sign[b] for b in w.encode()]) for w in words]
        proposed = [self._greedy(w) for w in signed]
        counts = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int64)
        home = np.repeat(np.arange(len(words)), counts)
        bad = np.zeros(len(words), bool)
        bad[home[~self.own[flat]]] = True
        border = np.flatnonzero(home[1:] == home[:-1])
        if len(border):
            pairs, back = np.unique((flat[border] << 32) | flat[border + 1], return_inverse=True)
            ok = self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            bad[home[border[~ok[back]]]] = True
        failing = np.flatnonzero(bad)
        for k, ids in zip(failing, self._exact([[self.vocab[s] for s in [*signed[k][:-1], signed[k][-1] + self.suffix]] for k in failing])):
            proposed[k] = ids
        names, tokens = self.names, self.tokens
        for w, ids in zip(words, proposed):
            self.ids[w], self.shown[w] = " ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        plain = unicodedata.normalize("NFC", text) if not text.isascii() else text
        plain = self.blank.sub(" ", plain) if self.blank else plain
        plain = plain.lower() if "Σ" not in plain else plain.replace("Σ", "σ").lower()  # by character, not by context
        return self.split.findall(plain)

    def parts(self, text: str) -> list[str]:
        """Words and marked special tokens, in order."""
        if self.special_cut and "<|" in text:
            out = []
            for k, piece in enumerate(self.special_cut.split(text)):
                out += [SPECIAL + piece] if k % 2 else self.words(piece)
            return out
        return self.words(text)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, ids joined by blanks, and the decoded text."""
        split = [self.parts(t) for t in texts]
        words = set().union(*split)
        new = words - self.ids.keys()
        for w in new & self.old_ids.keys():
            self.ids[w], self.shown[w] = self.old_ids[w], self.old_shown[w]
        new -= self.ids.keys()
        if len(self.ids) + len(new) > MEMORY // 2:  # a new generation; words of the one before come back when they are met
            keep = (words - new) | self.fixed
            self.old_ids, self.old_shown = self.ids, self.shown
            self.ids, self.shown = ({w: old[w] for w in keep} for old in (self.ids, self.shown))
        if new:
            self.learn(list(new))
        out = []
        for p in split:
            ids = " ".join(map(self.ids.__getitem__, p))
            out.append((ids.count(" ") + 1 if p else 0, ids, " ".join(map(self.shown.__getitem__, p))))
        for w in new:
            if len(w) > LONG:
                del self.ids[w], self.shown[w]
        return out

    def encode_all(self, texts: list[str], digests: bool) -> list[tuple]:
        """For each text: number of tokens, and its ids and decoded text, or the SHA-256 of both; long texts piece by piece."""
        out = []
        short = [t for t in texts if len(t) <= PIECE]
        known = iter(self.encode(short) if short else [])
        for t in texts:
            if len(t) <= PIECE:
                n, ids, shown = next(known)
                out.append((n, _sha(ids), _sha(shown)) if digests else (n, [int(x) for x in ids.split()], shown))
                continue
            total, sums, kept = 0, (hashlib.sha256(), hashlib.sha256()), ([], [])
            for piece in pieces(t):
                n, *pair = self.encode([piece])[0]
                if n and digests:
                    for h, x in zip(sums, pair):
                        h.update((" " * (total > 0) + x).encode())
                elif n:
                    kept[0].extend(map(int, pair[0].split()))
                    kept[1].append(pair[1])
                total += n
            out.append((total, *(h.hexdigest() for h in sums)) if digests else (total, kept[0], " ".join(kept[1])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(text: str, size: int = PIECE):
    """The text in parts of ``size`` signs or a little more, each but the first beginning with ASCII white space."""
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@kernels.large("bpe")
@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, digests: bool = False, text_col: str = "text") -> DataFrame:
    """The documents with n_tokens, and token_ids and decoded, or their SHA-256 (ids_sha256, decoded_sha256).

    ``path``: the vocabulary file, at the same place on every executor.
    """
    kinds = {"n_tokens": T.LongType()} | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()})
    schema = T.StructType([f for f in docs.schema.fields if f.name in kernels.others(docs.columns, kinds)] + [T.StructField(k, v) for k, v in kinds.items()])
    types = {"n_tokens": pa.int64()} | ({"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {"token_ids": pa.list_(pa.int32()), "decoded": pa.string()})

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            _, offs = kernels.text_buffers(batch.column(text_col))
            for i, j in kernels.groups(offs, 1 << (19 if digests else 17)):  # ids and decoded texts take many times the memory of digests
                part = batch.slice(i, j - i)
                got = tok.encode_all([t or "" for t in part.column(text_col).to_pylist()], digests)
                yield kernels.append(part, {k: pa.array([g[n] for g in got], t) for n, (k, t) in enumerate(types.items())})

    return docs.mapInArrow(kernels.released(run, "bpe"), schema)
