"""BPE encoding by per-prefix dynamic programming, and decoding (operator 1).

A BPE vocabulary has one encoding per string, and the encoding of a prefix ends in exactly
one token.  That token is found left to right: an Aho-Corasick automaton of the
vocabulary, in place of a suffix automaton, yields every token that ends at a position, and a token is the right one when the
prefix before it ends in a token it is *compatible* with (the two would not have been merged
across their seam).  Back-pointers then give the ids.  A piece of n bytes costs O(n) matches,
so text without any space stays linear.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts_of

#: The split pattern of byte-level BPE files and Unicode white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file; built once per Python worker."""

    def __init__(self, path: str, ranks: str | None = None, cache_size: int = 500_000):
        """``ranks``: a rank file of the same vocabulary; whole texts are then encoded by tiktoken."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        to_bytes = lambda s: bytes(symbol[c] for c in s)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token[i] = to_bytes(s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.id_of = {to_bytes(s): i for s, i in vocab.items()}
        # made[i]: rank of the merge that makes token i, -1 for single bytes
        self.made, self.left, self.right, self.pair = [-1] * size, [-1] * size, [-1] * size, {}
        for rank, m in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            i = self.id_of[self.token[a] + self.token[b]]
            if max(self.made[a], self.made[b]) >= rank or self.made[i] >= 0:
                raise ValueError("merges must build each token once, after its parts")
            self.pair[a, b] = rank
            self.made[i], self.left[i], self.right[i] = rank, a, b
        self.whole = [False] * size  # tokens whose own bytes encode to themselves
        for i in sorted(vocab.values(), key=self.made.__getitem__):
            a, b, r = self.left[i], self.right[i], self.made[i]
            self.whole[i] = r < 0 or (self.whole[a] and self.whole[b] and self._seam(a, b, r, r, top=True))
        self.automaton = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.automaton.add_word(b.decode("latin-1"), i << 10 | len(b))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.chunks = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.odd = re.compile(f"[{SPACES}]{{2}}|[{SPACES.replace(' ', '', 1).replace(chr(10), '', 1)}\x00-\x02]").search
        self.spaces = {chr(c) for c in range(0x3001) if chr(c) in SPACES or 0x2000 <= c <= 0x200A}
        self.ranks = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.fits: dict[int, bool] = {}  # by first id * 2**20 + second id
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole_all, self.made_all = np.array(self.whole), np.array(self.made)
        self.left_all, self.right_all = np.array(self.left), np.array(self.right)
        key, rank = (np.array(list(x), np.int64) for x in ((a << 20 | b for a, b in self.pair), self.pair.values()))
        self.pair_key, self.pair_rank = key[key.argsort()], rank[key.argsort()]
        self.memo_key, self.memo_fit = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _seam(self, a: int, b: int, la: float, lb: float, top: bool = False) -> bool:
        """Whether no merge joins the end of ``a`` with the start of ``b``.

        ``la``/``lb``: the rank at which a/b is itself used up by a merge on its own side.
        The two spines along the seam are undone from the latest merge to the earliest; a pair
        that stands side by side before either part is used up would have been merged instead.
        On equal rank the leftmost merge goes first.
        """
        made, pair = self.made, self.pair
        while True:
            r = pair.get((a, b))
            if r is not None and not top and r < la and r <= lb:
                return False
            top = False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                la, a = made[a], self.right[a]
            else:
                lb, b = made[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` together is exactly [a, b]."""
        fit = self.fits.get(a << 20 | b)
        if fit is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            fit = self.fits[a << 20 | b] = self._seam(a, b, float("inf"), float("inf"))
        return fit

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece, by the last token of every prefix."""
        i = self.id_of.get(piece)
        if i is not None and self.whole[i]:
            return [i]
        last, back, fits, compatible = [-1] * len(piece), [0] * len(piece), self.fits.get, self.compatible
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            if last[end] < 0:
                t, n = found >> 10, found & 1023
                if n > end:
                    if self.whole[t]:
                        last[end], back[end] = t, n
                else:
                    p = last[end - n]
                    fit = fits(p << 20 | t)
                    if compatible(p, t) if fit is None else fit:
                        last[end], back[end] = t, n
        ids, at = [], len(piece) - 1
        while at >= 0:
            ids.append(last[at])
            at -= back[at]
        ids.reverse()
        return ids

    def _compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays, with a direct-mapped memo of the pairs seen lately."""
        key = (a.astype(np.int64) << 20) | b
        slot = self._slots(key)
        fit, new = self.memo_fit[slot], np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            pairs, where = np.unique(key[new], return_inverse=True)
            found = self._seam_all(pairs >> 20, pairs & 0xFFFFF)
            fit[new] = found[where]
            # where several pairs share a slot, one of them stays: its key and its answer
            at, first = np.unique(self._slots(pairs), return_index=True)
            self.memo_key[at], self.memo_fit[at] = pairs[first], found[first]
        return fit

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7C1) >> 20) & (len(self.memo_key) - 1)

    def _seam_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_seam`` for arrays of different pairs."""
        fit, at = np.ones(len(a), bool), np.arange(len(a))
        la = np.full(len(a), 1 << 40)
        lb = la.copy()
        while len(at):
            key = (a << 20) | b
            k = self.pair_key.searchsorted(key).clip(max=len(self.pair_key) - 1)
            r = np.where(self.pair_key[k] == key, self.pair_rank[k], 1 << 41)
            bad = (r < la) & (r <= lb)
            fit[at[bad]] = False
            ma, mb = self.made_all[a], self.made_all[b]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            at, a, b, la, lb, ma, mb = (x[go] for x in (at, a, b, la, lb, ma, mb))
            up = ma > mb
            la, lb = np.where(up, ma, la), np.where(up, lb, mb)
            a, b = np.where(up, self.right_all[a], a), np.where(up, b, self.left_all[b])
        return fit

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """``encode_piece`` for many pieces at once: step e settles prefix e of all of them.

        Ids come as little-endian unsigned 32-bit bytes.
        """
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # a character that is in no token in between
        joined = "\u0100".join([p.decode("latin-1") for p in pieces])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        end, t, n = found[::2], found[1::2] >> 10, found[1::2] & 1023
        rel = end - starts[starts.searchsorted(end, "right") - 1]
        order = np.argsort(rel, kind="stable")
        end, t, n, rel = end[order], t[order], n[order], rel[order]
        steps = rel.searchsorted(np.arange(sizes.max() + 1))
        last, back = np.full(len(joined), -1), np.zeros(len(joined), np.int64)
        for e in range(len(steps) - 1):
            at, tok, ln = (x[steps[e]:steps[e + 1]] for x in (end, t, n))
            ok = self.whole_all[tok]
            inner = np.flatnonzero(ln <= e)
            ok[inner] = self._compatible_all(last[at[inner] - ln[inner]], tok[inner])
            last[at[ok]], back[at[ok]] = tok[ok], ln[ok]
        used, at, lo = np.zeros(len(joined), bool), starts + sizes - 1, starts
        while len(at):
            used[at] = True
            at = at - back[at]
            more = at >= lo
            at, lo = at[more], lo[more]
        ends = np.flatnonzero(used)
        ids, cut = last[ends].astype("<u4").tobytes(), (4 * ends.searchsorted([*starts, len(joined)])).tolist()
        return [ids[i:j] for i, j in zip(cut, cut[1:])]

    def _keys(self, text: str) -> list[str]:
        """A text as cache keys, one per white space plus the run that follows it.

        A piece never holds white space after other characters, so these encode one by one.
        Key w stands for space + w, \\x00 + w for line end + w, \\x01 + w for w at the start of
        the text; any other chunk (runs of white space, other kinds of it) is \\x02 + chunk.
        """
        if not self.odd(text):
            return ("\x01" + text).replace("\n", " \x00").split(" ")
        return [c[1:] if c[0] == " " and c[1:2] not in self.spaces and c[1:2] > "\x02" else "\x02" + c for c in self.chunks(text)]

    @staticmethod
    def _chunk(key: str) -> str:
        return {"\x00": "\n", "\x01": "", "\x02": ""}.get(key[:1], " " + key[:1]) + key[1:]

    def _learn(self, keys: list[str]) -> None:
        """Puts the ids of new keys into the cache."""
        chunks = list(map(self._chunk, keys))
        parts = [[c.encode()] if c.isalpha() or c[:1] == " " and c[1:].isalpha() else [p.encode() for p in self.split.findall(c)]
                 for c in chunks]
        known = dict.fromkeys(p for ps in parts for p in ps)
        short = [p for p in known if len(p) <= 64]
        known |= zip(short, self.encode_pieces(short))
        for p, ids in known.items():
            if ids is None:
                ids = self.encode_piece(p)
                known[p] = pack(f"<{len(ids)}I", *ids)
        for k, ps in zip(keys, parts):
            self.cache[k] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode_batch(self, texts: list[str], specials: bool = True) -> list[np.ndarray]:
        """Ids of whole texts; special tokens in them become their own ids (or are plain text)."""
        parts = [self.specials.split(t) if specials and any(s in t for s in self.special) else [t] for t in texts]
        if self.ranks:
            return [np.concatenate([np.array([self.special[p]], "<u4") if specials and p in self.special else
                                    self.ranks.encode_to_numpy(p, disallowed_special=()) for p in ps]) for ps in parts]
        if len(self.cache) > self.cache_size:  # two generations: what is still in use moves over
            self.cache, self.older = {}, self.cache
        keys = [[None if specials and p in self.special else self._keys(p) for p in ps] for ps in parts]
        got = [[k and list(map(self.cache.get, k)) for k in ks] for ks in keys]
        new = {w for ks, gs in zip(keys, got) for k, g in zip(ks, gs) if k and None in g for w, x in zip(k, g) if x is None}
        self.cache |= {w: self.older[w] for w in new if w in self.older}
        self._learn([w for w in new if w not in self.cache])
        get, out = self.cache.__getitem__, []
        for ps, ks, gs in zip(parts, keys, got):
            out.append(np.frombuffer(b"".join([pack("<I", self.special[p]) if k is None else
                                               b"".join(map(get, k) if None in g else g) for p, k, g in zip(ps, ks, gs)]), "<u4"))
        for w in new:
            if len(w) > 48:  # bounds the cache's bytes
                self.cache.pop(w, None)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str | None], Bpe] = {}


def bpe(path: str, ranks: str | None = None) -> Bpe:
    """The worker's encoder for a vocabulary file."""
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = Bpe(path, ranks)
    return _LOADED[path, ranks]


def token_table(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of whole texts; a null text is empty.

    One row per input row: ties and repeated rows each keep theirs; an empty table gives an
    empty table; further columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary)
        for b in batches:
            ids = model.encode_batch(texts_of(b))
            flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([model.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")) \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, per row.

    The same encoder and decoder as ``token_table`` without moving ids back to the JVM.
    Null text: zero tokens, digests of the empty string.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary)
        decimal = list(map(str, range(len(model.token))))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in map(np.ndarray.tolist, model.encode_batch(texts_of(b))):
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(model.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, OUT)
