"""SentencePiece BPE by vectorised merge rounds.

A text is cut where no vocabulary piece can reach across (before a run of word marks), equal words are encoded once
for each batch, and all new words are merged together: the symbols of all words lie in one flat array, each round
looks up every neighbouring pair, takes the least rank within each word (a segmented minimum), merges all its leftmost
non-overlapping places at once, and compacts the array, until no pair remains.

Merging equal pairs at once equals merging one by one unless a new pair ranks as high as the one just merged; a word
where that shows, or could have shown between neighbouring places, is encoded again with one merge at a time, from a heap
over a linked list, so that a long run of one character costs its length times a logarithm.

Cases: null is the empty text, with the end id alone; characters outside the vocabulary become byte ids; rows are
independent, so repeated rows and further columns change nothing. Only identity normalisation is supported, and
checked when the model is loaded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table

MARK = "▁"
_NEVER = np.int64(1 << 40)


class Bpe:
    """The tables of a model file and the merge rounds over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.eos = sp.get_piece_size(), sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        special = {i for i in range(self.size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        if len(self.bytes) != 256 or any(sp.normalize(x) != MARK + x.replace(" ", MARK) for x in ("ﬁ  Ⅷ ", " é\xa0")):
            raise ValueError("only models with byte fallback, identity normalisation and a leading mark")
        self.spelled = [b"" if i in special else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        self.names = [str(i) for i in range(self.size)]
        ids = {n: i for i, n in enumerate(names) if i not in special}
        self.cut_at_marks = not any(MARK in n.lstrip(MARK) for n in ids)
        # a symbol is a piece's id, or size + code point for a character that is no piece
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        for n, i in ids.items():
            if len(n) == 1:
                self.char[ord(n)] = i
        rank = {i: int(round(-sp.get_score(i))) for i in ids.values()}
        self.base = self.size + 0x110000
        symbol = lambda s: ids.get(s, int(self.char[ord(s)]) if len(s) == 1 else None)
        pairs = {}
        for n, i in ids.items():
            for k in range(1, len(n)):
                a, b = symbol(n[:k]), symbol(n[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.cut_at_marks else r"(?s:.+)")
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}

    def merge_rounds(self, words: list[str], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, in order, once no pair remains, and how many each word has."""
        if one_by_one:
            each = [self.one_at_a_time(w) for w in words]
            return np.array([x for e in each for x in e], np.int64), np.array([len(e) for e in each], np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        n = np.array([len(w) for w in words], np.int64)
        word = np.flatnonzero(n)  # those still at work
        n, again = n[word], []
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = np.full(len(word), -1, np.int64)
        several = np.zeros(len(word), bool)
        rank, to = self.look_up(sym[:-1], sym[1:]) if len(sym) else (sym, sym)
        rank, to = np.append(rank, _NEVER), np.append(to, 0)
        while len(word):
            start = np.cumsum(n) - n
            seg = np.repeat(np.arange(len(word)), n)
            rank[start + n - 1] = _NEVER
            least = np.minimum.reduceat(rank, start)
            odd = several & (least <= last) & (least < _NEVER)
            done = (least == _NEVER) & ~odd
            if odd.any():
                again += word[odd].tolist()
            if done.any():
                ended.append((word[done], n[done], sym[done[seg]]))
            go = ~done & ~odd
            where = np.flatnonzero(rank == np.where(go, least, -1)[seg])
            new = np.ones(len(where), bool)
            new[1:] = seg[where[1:]] != seg[where[:-1]]
            new[1:] |= where[1:] != where[:-1] + 1  # of a run of neighbouring places every other one, from the left
            run = np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))
            first = where[(np.arange(len(where)) - run) % 2 == 0]
            side = np.flatnonzero((first[1:] == first[:-1] + 2) & (seg[first[1:]] == seg[first[:-1]]))
            if len(side):  # would the left one's piece rather take the start of the right one?
                own = seg[first[side]]
                risky = np.unique(own[self.look_up(to[first[side]], sym[first[side + 1]])[0] <= least[own]])
                if len(risky):
                    again += word[risky].tolist()
                    go[risky] = False
                    first = first[go[seg[first]]]
            sym[first] = to[first]
            keep = go[seg]
            keep[first + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[first] = True
            merged = np.bincount(seg[first], minlength=len(word))
            sym, rank, to, fresh = sym[keep], rank[keep], to[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]  # only pairs beside a merge have changed
            at = np.flatnonzero(fresh)
            at = at[at < len(sym) - 1]
            rank[at], to[at] = self.look_up(sym[at], sym[at + 1])
            last, n, several, word = least[go], (n - merged)[go], (merged > 1)[go], word[go]
        if again:
            ended.append((np.array(again), *self.merge_rounds([words[i] for i in again], True)[::-1]))
        if not ended:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        who, size, flat = (np.concatenate(x) for x in zip(*ended, strict=True))
        counts = np.zeros(len(words), np.int64)
        counts[who] = size
        begins = np.zeros(len(words), np.int64)
        begins[who] = np.cumsum(size) - size
        place = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))
        return flat[place], counts

    def one_at_a_time(self, word: str) -> list[int]:
        """The symbols of one word: always the leftmost pair of the least rank next."""
        at = self.char[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        first = self.look_up(at[:-1], at[1:])[0]
        open_ = np.flatnonzero(first < _NEVER)
        heap = (first[open_] << 32 | open_).tolist()
        heapify(heap)
        sym, n, base, pairs = at.tolist(), len(at), self.base, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            found = pairs.get(sym[i] * base + sym[j]) if sym[i] >= 0 and j < n else None
            if found is None or found[0] != top >> 32:
                continue  # a neighbour has changed since
            sym[i], sym[j], after[i] = found[1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                right = pairs.get(sym[i] * base + sym[after[i]])
                if right is not None:
                    heappush(heap, right[0] << 32 | i)
            k = before[i]
            left = pairs.get(sym[k] * base + sym[i]) if k >= 0 else None
            if left is not None:
                heappush(heap, left[0] << 32 | k)
        return [s for s in sym if s >= 0]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), self.made[at]

    def to_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
        """Ids and how many each word has: a character that is no piece becomes the ids of its bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.tolist(), counts.tolist()
        raw = [[self.bytes[b] for b in chr(s - self.size).encode("utf-8", "replace")] for s in symbols[odd].tolist()]
        more = np.array([len(r) for r in raw])
        grown = np.ones(len(symbols), np.int64)
        grown[odd] = more
        out = np.repeat(symbols, grown)
        at = np.repeat((np.cumsum(grown) - grown)[odd], more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        out[at] = [i for r in raw for i in r]
        ends = np.concatenate(([0], np.cumsum(grown)))[np.concatenate(([0], np.cumsum(counts)))]
        return out.tolist(), np.diff(ends).tolist()

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str], keep: int = 300_000, longest: int = 64) -> dict[str, tuple[int, str, bytes, bytes]]:
        """(ids, their spelling, what they decode to, the ids as int32) of each word; words of a common length are kept for later."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > keep:
            self.known.clear()
            new = list(words)
        known = self.known
        held = {w: known[w] for w in words if w in known}
        ids, counts = self.to_ids(*self.merge_rounds(new))
        raw = np.array(ids, np.int32).tobytes()
        names, spelled, at = [self.names[i] for i in ids], [self.spelled[i] for i in ids], 0
        for w, n in zip(new, counts, strict=True):
            held[w] = (n, " ".join(names[at : at + n]), b"".join(spelled[at : at + n]), raw[4 * at : 4 * (at + n)])
            at += n
        if longest:
            self.known.update((w, held[w]) for w in new if len(w) <= longest)
        return held

    def encode(self, text: str, end: bool = True) -> list[int]:
        out = self.to_ids(*self.merge_rounds(self.split(text)))[0]
        return [*out, self.eos] if end else out

    def decode(self, ids: list[int]) -> str:
        return _text(b"".join([self.spelled[i] for i in ids]))


def _text(raw: bytes) -> str:
    """Without the space that the leading mark stands for; a byte that is no UTF-8 becomes one replacement character."""
    raw = raw[1:] if raw[:1] == b" " else raw
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out = []
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as e:
                out += [raw[: e.start].decode(), "�"]
                raw = raw[e.start + 1 :]
        return "".join(out)


_MODELS: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    """One for each worker process."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(bpe: Bpe, texts: list[str], chars: int = 1_500_000) -> Iterator[tuple[int, str, bytes, bytes]]:
    """(how many ids, their spelling, the ids as int32, the decoded text in UTF-8) of each text, some at a time."""
    end = np.array([bpe.eos], np.int32).tobytes()
    for part in pieces([(t,) for t in texts], chars):
        split = [bpe.split(t) for (t,) in part]
        held = bpe.learn(set().union(*split))
        for words in split:
            got = [held[w] for w in words]
            raw = b"".join([g[2] for g in got])
            try:
                raw.decode()
                raw = raw[1:] if raw[:1] == b" " else raw
            except UnicodeDecodeError:
                raw = _text(raw).encode()
            yield sum([g[0] for g in got]) + 1, " ".join([*[g[1] for g in got], str(bpe.eos)]), b"".join([*[g[3] for g in got], end]), raw


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and, if wanted, token_ids and decoded, of every row. No shuffle.

    The end id is the last id; the digests are those of the decimal ids joined by spaces and of the decoded text.
    """
    small_batches(docs.sparkSession)
    where = path or tokenizer_path()
    more = [("token_ids array<int>",)] * with_ids + [("decoded string",)] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, i, d, raw, texts = [], [], [], [], []
            for count, spelled, ids, decoded in encoded(model(where), [t or "" for t in b.column("__text").to_pylist()]):
                n.append(count)
                i.append(hashlib.sha256(spelled.encode()).hexdigest())
                d.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    raw.append(ids)
                if with_text:
                    texts.append(decoded.decode())
            columns = [b.column(key), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n, dtype=np.int64))).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32))))
            if with_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *(x[0].split()[0] for x in more)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, ", ".join([f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", *(x[0] for x in more)]))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
