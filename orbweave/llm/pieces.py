"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together, one place at a time: hashes of all substrings that end there probe the sorted
keys of the pieces, the pieces found extend the best path to where they start, and a vectorised maximum of the paths'
scores stores the back-pointer.

The model is a BPE model. The plain Viterbi path, with the largest sum of scores, is not what BPE merges give, so
a step also asks whether BPE would leave the last piece of the path and the new piece side by side; that is decided by
undoing the two pieces' merges in turn, for all words at once. Exactly one path of each prefix passes, and it is the BPE
encoding. load(merges=False) leaves that question out: the plain Viterbi path of a unigram model.
Pieces of several spaces have one score, below all others, so they merge last, from the left: what they give follows from
the number of spaces. Texts are cut before spaces and around line feeds, which no piece crosses.

All words of a batch are spans of bytes, known by a 64-bit hash; distinct ones are encoded once, and kept for later
batches as sorted hashes beside their ids, up to CACHE words of KEEP bytes at most (tens of bytes each). A longer word is
cut where two letters meet that are side by side in no piece; what is still longer than LONG letters walks alone, by
the same steps with a dictionary, in time linear in its length.

Decoding gathers the bytes of all pieces of a batch in one expression.

Defined results: a null text counts as empty and has no ids; a text that holds U+2581 comes back with a space there;
all other texts come back as they are. Texts of one run of spaces, one letter or one token take time linear in their
length. Repeated rows, null ids and extra columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orbweave.llm import batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that are kept, the longest one in bytes, words that advance together, and letters of a word that walks alone.
CACHE, KEEP, LEARN, LONG = 250_000, 64, 20_000, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text at a time, and how many times so many share a look for new words.
PIECE, TOGETHER = 500_000, 12
_NONE = np.iinfo(np.int64).max


class Sorted:
    """Sorted 64-bit keys with values; a table of where each start of 20 bits begins leaves a step or two of the search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(values[order], values[-1:])
        first = np.searchsorted(keys[order], np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44))
        first[-1] = len(keys)
        self.first, self.steps, self.some = first[:-1].astype(np.int32), int(np.diff(first).max()), np.diff(first) > 0

    def maybe(self, wanted: np.ndarray) -> np.ndarray:
        return self.some[wanted >> np.uint64(44)]

    def probe(self, wanted: np.ndarray, missing: int) -> np.ndarray:
        place = self.first[wanted >> np.uint64(44)]
        for _ in range(self.steps):
            place = place + (self.keys[place] < wanted)
        return np.where(self.keys[place] == wanted, self.values[place], missing)


def _pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one.astype(np.uint64) << np.uint64(20) | two.astype(np.uint64)) * _BASE


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Running hashes of rows of code points: out[:, k] is that of the first k."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + (codes[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


@dataclass
class Vocabulary:
    """Pieces in the order in which merges take them: characters first, then merged pieces by score."""

    ids: np.ndarray  # rank -> id
    left: np.ndarray  # rank -> rank; itself for characters
    right: np.ndarray
    pairs: Sorted  # of the left and the right piece: the rank they merge to
    pieces: Sorted  # of the hash of a substring: its rank
    longest: int
    scores: dict[str, tuple[float, int]]
    byte_ids: np.ndarray
    powers: np.ndarray
    chars: int
    piece_bytes: np.ndarray  # bytes of all ids, side by side
    piece_at: np.ndarray
    values: np.ndarray  # score by rank; the last one is that of a letter without a piece
    merges: bool
    spaces: list[np.ndarray]  # ids of 0, 1, ... spaces, up to one less than the longest piece of spaces, and of that piece

    def __post_init__(self):
        self.walk: Walk | None = None
        # pairs asked for lately and the answers, one for each slot
        self.asked, self.answer = np.full(1 << 20, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(1 << 20, bool)
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "long", "flat", "flat_at", "asked", "answer", "walk")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self):
        """known: sorted hashes of the kept words; flat: their ids, from flat_at[k] to flat_at[k + 1]."""
        self.known, self.flat, self.flat_at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.long = self.known  # those that go after the batch


def merge(word: str, scores: dict[str, tuple[float, int]]) -> tuple[list[str], list[tuple[str, str]]]:
    """BPE by the book: the best-scored pair, the leftmost first, until none is a piece. The parts, and the merges."""
    parts, done = list(word), []
    while len(parts) > 1:
        best = max((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in scores), key=lambda k: (scores[parts[k] + parts[k + 1]][0], -k), default=None)
        if best is None:
            break
        done.append((parts[best], parts[best + 1]))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts, done


def load(path: str = MODEL, merges: bool = True) -> Vocabulary:
    """Reads a BPE model with byte fallback on the driver; the tables (a few MB) go to the tasks with the function."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}
    chars = sorted((p for p in scores if len(p) == 1), key=lambda p: scores[p][1])
    several = sorted((p for p in scores if len(p) > 1 and not p.startswith(SPACE * 2)), key=lambda p: (-scores[p][0], scores[p][1]))
    order, split = list(chars), {}
    for p in several:
        parts, done = merge(p, scores)
        if len(parts) == 1:  # else BPE never makes it
            order.append(p)
            split[p] = done[-1]
    rank = {p: k for k, p in enumerate(order)}
    left = np.array([rank[split[p][0]] if p in split else k for k, p in enumerate(order)])
    right = np.array([rank[split[p][1]] if p in split else k for k, p in enumerate(order)])
    n = len(chars)
    longest = max(map(len, order))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE)]))
    keys = np.array([_hashes(np.array([[ord(c) for c in p]]))[0, -1] for p in order], np.uint64)
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    texts = [b""] * sp.get_piece_size()
    for p, (_, i) in scores.items():
        texts[i] = p.replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        texts[i] = bytes([b])
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = [p for p in scores if p == SPACE * len(p)]
    widest = max(map(len, runs), default=1)
    spaces = [np.array([scores[p][1] if p in scores else byte_ids[0x20] for p in merge(SPACE * k, {r: scores[r] for r in runs})[0]], np.int32) for k in range(widest + 1)]
    values = np.array([scores[p][0] for p in order] + [min(s for s, _ in scores.values() if s > -1e8) - 10.0])
    return Vocabulary(np.array([scores[p][1] for p in order]), left, right, Sorted(_pair_key(left[n:], right[n:]), np.arange(n, len(order))), Sorted(keys, np.arange(len(order))), longest, scores, byte_ids, powers, n, np.frombuffer(b"".join(texts), np.uint8), at, values, merges, spaces)


def side_by_side(v: Vocabulary, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether BPE leaves two pieces (ranks) unmerged, with all merges inside them done, when they adjoin."""
    key = _pair_key(one, two)
    slot = key >> np.uint64(44)
    out = v.answer[slot]
    at = np.flatnonzero(v.asked[slot] != key)
    ask = at
    one, two, limit = one[at], two[at], np.full(len(at), _NONE)
    out[at] = False
    while len(at):
        pair = _pair_key(one, two)
        going = np.ones(len(at), bool)
        rows = np.flatnonzero(v.pairs.maybe(pair))
        merged = v.pairs.probe(pair[rows], _NONE)
        going[rows] = (merged >= limit[rows]) | (merged == _NONE)
        at, one, two, limit = at[going], one[going], two[going], limit[going]
        # undo the later merge of the two; if that one is a character, the other's
        first = one > two
        atom_one, atom_two = v.right[one] == one, v.left[two] == two
        both = atom_one & atom_two
        out[at[both]] = True
        undo_one = ~both & np.where(first, ~atom_one, atom_two)
        undo_two = ~both & ~undo_one
        limit = np.where(undo_one, one, two + 1)
        one, two = np.where(undo_one, v.right[one], one), np.where(undo_two, v.left[two], two)
        at, one, two, limit = at[~both], one[~both], two[~both], limit[~both]
    v.asked[slot[ask]] = key[ask]
    # of two pairs with one slot the last one stands in both tables
    v.answer[slot[ask]] = out[ask]
    return out


def _encode_equal(v: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (rows of code points) side by side, and how many each has."""
    m, n = codes.shape
    running = np.ascontiguousarray(_hashes(codes).T)
    unknown = len(v.ids)
    last, back, best = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -np.inf)
    best[0] = 0
    for j in range(1, n + 1):
        for size in range(1, min(j, v.longest) + 1):
            key = running[j] - running[j - size] * v.powers[size]
            before = last[j - size]
            rows = np.flatnonzero(v.pieces.maybe(key) & ((before >= 0) | (j == size))) if size > 1 else np.flatnonzero((before >= 0) | (j == 1))
            if not len(rows):
                continue
            found = v.pieces.probe(key[rows], unknown if size == 1 else -1)
            rows, found = rows[found >= 0], found[found >= 0]
            if v.merges and j > size and len(rows):
                a = before[rows]
                good = (a == unknown) | (found == unknown)
                known = np.flatnonzero(~good)
                good[known] = side_by_side(v, a[known], found[known])
                rows, found = rows[good], found[good]
            score = best[j - size, rows] + v.values[found]
            better = score > best[j, rows]
            rows = rows[better]
            best[j, rows], last[j, rows], back[j, rows] = score[better], found[better], size
    place, tokens, column = np.full(m, n), [], np.arange(m)
    while (place > 0).any():
        tokens.append(np.where(place > 0, last[place, column], -1))
        if (tokens[-1] == unknown).any():
            # a character without a piece is its bytes, the last one first
            widest = 0
            for k in np.flatnonzero(tokens[-1] == unknown).tolist():
                raw = chr(codes[k, place[k] - 1]).encode("utf-8", "surrogatepass")[::-1]
                for b, byte in enumerate(raw):
                    if b > widest:
                        tokens.append(np.full(m, -1))
                        widest = b
                    tokens[len(tokens) - 1 - widest + b][k] = -2 - byte
        place = np.where(place > 0, place - back[place, column], 0)
    grid = np.stack(tokens[::-1]).T
    used = grid != -1
    ranks = grid[used]
    return np.where(ranks >= 0, v.ids[np.maximum(ranks, 0)], v.byte_ids[np.clip(-2 - ranks, 0, 255)]).astype(np.int32), used.sum(1)


class Walk:
    """The same steps for one long word, with dictionaries: time linear in its length, whatever it repeats."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs = v, {(int(a), int(b)): len(v.ids) - len(v.left[v.chars :]) + k for k, (a, b) in enumerate(zip(v.left[v.chars :], v.right[v.chars :], strict=True))}
        id_rank = {i: k for k, i in enumerate(v.ids.tolist())}
        self.rank = {p: id_rank[i] for p, (_, i) in v.scores.items() if i in id_rank}
        self.left, self.right, self.value, self.sure = v.left.tolist(), v.right.tolist(), v.values.tolist(), {}
        self.two = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}

    def parts(self, word: str) -> list[str]:
        """Cut where two letters meet that no piece has side by side."""
        cut = [0, *[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.two], len(word)]
        return [word[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def adjoin(self, one: int, two: int) -> bool:
        limit = _NONE
        while True:
            if self.pairs.get((one, two), _NONE) < limit:
                return False
            atom_one, atom_two = self.right[one] == one, self.left[two] == two
            if atom_one and atom_two:
                return True
            if not atom_one and (one > two or atom_two):
                limit, one = one, self.right[one]
            else:
                limit, two = two + 1, self.left[two]

    def encode(self, word: str) -> np.ndarray:
        unknown, rank, sure, value = len(self.v.ids), self.rank, self.sure, self.value
        last, back, best = [-1] * (len(word) + 1), [0] * (len(word) + 1), [0.0] + [-np.inf] * len(word)
        wide, seen = self.v.longest, {}
        for j in range(1, len(word) + 1):
            # what repeats goes on alike: with merges, the next step follows from the letters and pieces before it
            state = (word[j - wide : j], *last[j - wide : j]) if self.v.merges and j >= wide else None
            if state in seen:
                last[j], back[j] = seen[state]
                best[j] = best[j - back[j]] + value[last[j]]
                continue
            for size in range(1, min(j, wide) + 1):
                new, a = rank.get(word[j - size : j], unknown if size == 1 else -1), last[j - size]
                if new < 0 or (a < 0 and j > size):
                    continue
                if self.v.merges and j > size and a != unknown and new != unknown:
                    pair = a << 20 | new
                    if pair not in sure:
                        if len(sure) > LEARN * 10:
                            sure.clear()
                        sure[pair] = self.adjoin(a, new)
                    if not sure[pair]:
                        continue
                if best[j - size] + value[new] > best[j]:
                    best[j], last[j], back[j] = best[j - size] + value[new], new, size
            if state is not None and len(seen) < LEARN:
                seen[state] = last[j], back[j]
        out, j = [], len(word)
        while j:
            out.append(self.v.byte_ids[np.frombuffer(word[j - 1].encode("utf-8", "surrogatepass"), np.uint8)] if last[j] == unknown else self.v.ids[last[j] : last[j] + 1])
            j -= back[j]
        return np.concatenate(out[::-1]).astype(np.int32)


def _spaces(v: Vocabulary, n: int) -> np.ndarray:
    widest = len(v.spaces) - 1
    return np.concatenate([np.tile(v.spaces[widest], n // widest), v.spaces[n % widest]])


def _gather(values: np.ndarray, at: np.ndarray, wanted: np.ndarray, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """values[at[k] : at[k + 1]] for each k wanted (or up to end[k]), side by side; and where each begins."""
    sizes = (at[1:] if end is None else end)[wanted] - at[wanted]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(at[wanted] - begin[:-1], sizes) + np.arange(begin[-1])], begin


def _encode_rows(v: Vocabulary, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of any length up to LONG (code points side by side), and n + 1 places where each one's begin."""
    size = np.diff(at)
    order = np.argsort(size, kind="stable")
    out, number = [], np.zeros(len(size), np.int64)
    edge = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        for k in range(a, b, LEARN):
            rows = order[k : min(k + LEARN, b)]
            ids, number[rows] = _encode_equal(v, codes[at[rows][:, None] + np.arange(size[rows[0]])])
            out.append(ids)
    ids = np.concatenate(out) if out else np.zeros(0, np.int32)
    # they are in the order of lengths
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(number[order], out=place[1:])
    back = np.empty(len(size), np.int64)
    back[order] = np.arange(len(size))
    return _gather(ids, place, back)


def _encode_odd(v: Vocabulary, word: str) -> np.ndarray:
    """Ids of a word that is long or has several spaces before it."""
    plain = word.lstrip(" ")
    wide = len(word) - len(plain)
    if not plain:
        return _spaces(v, wide)
    v.walk = v.walk or Walk(v)
    parts = v.walk.parts(SPACE * (wide > 0) + plain)
    some = list(dict.fromkeys(p for p in parts if len(p) <= LONG))
    ids, at = _encode_rows(v, np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in some])]).astype(np.int64))
    found = {p: ids[at[k] : at[k + 1]] for k, p in enumerate(some)}
    for p in parts:
        if p not in found:
            found[p] = v.walk.encode(p)
    out = np.concatenate([found[p] for p in parts])
    if wide < 2:
        return out
    # the space before the word joins the others if the word leaves it alone
    lone = out[0] == v.scores[SPACE][1]
    return np.concatenate([_spaces(v, wide - 1 + lone), out[1:] if lone else out])


def learn(v: Vocabulary, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words (spans of bytes) with the spaces before them, and n + 1 places where each one's begin."""
    size = end - start
    odd = (size > KEEP) | ((size > 1) & (body[start] == 0x20) & (body[np.minimum(start + 1, len(body) - 1)] == 0x20))
    plain = np.flatnonzero(~odd)
    raw, at = _gather(body, np.append(start[plain], 0), np.arange(len(plain)), end[plain])
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x20] = ord(SPACE)
    letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ids, begin = _encode_rows(v, codes, letters[at])
    more = [_encode_odd(v, body[a:b].tobytes().decode()) for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True)]
    place = np.empty(len(size), np.int64)
    place[plain], place[odd] = np.arange(len(plain)), len(plain) + np.arange(len(more))
    begin = np.concatenate([begin, begin[-1] + np.cumsum([len(x) for x in more])]).astype(np.int64)
    return _gather(np.concatenate([ids, *more]), begin, place)


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with a space put before each, where its words begin, and n + 1 places of each text's first word.

    A word has the spaces before it; a line feed is one of its own. U+2581 is a space.
    """
    body, at = batches.string_bytes(column)
    if SPACE.encode() in body.tobytes():
        body, at = batches.string_bytes(pc.replace_substring(column, SPACE, " "))
    full = np.diff(at) > 0
    body = np.insert(body, at[:-1][full], 0x20)
    at = at + np.concatenate([[0], np.cumsum(full)])
    line, space = body == 0x0A, body == 0x20
    begin = line | space
    begin[1:] &= ~(space[1:] & space[:-1])
    begin[1:] |= line[:-1]
    begin[at[:-1][full]] = True
    begin = np.flatnonzero(begin)
    return body, begin, np.searchsorted(begin, at)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body, start, first = spans(column)
    end = np.append(start[1:], len(body)) if len(start) else start
    return batches.span_hashes(body, start, end), body, start, end, first


def _meet(v: Vocabulary, columns: list[pa.Array]) -> None:
    """Encodes the words of the texts that are not kept yet, all at once, and keeps them."""
    if len(v.known) > CACHE:
        v.forget()
    hashes, raw, size = [], [], []
    for column in columns:
        h, body, start, end, _ = _hashed(column)
        h, where = np.unique(h, return_index=True)
        place = np.minimum(np.searchsorted(v.known, h), max(len(v.known) - 1, 0))
        new = v.known[place] != h if len(v.known) else np.ones(len(h), bool)
        hashes.append(h[new])
        word, at = _gather(body, start, where[new], end)
        raw.append(word)
        size.append(np.diff(at))
    every, where = np.unique(np.concatenate(hashes), return_index=True)
    if not len(every):
        return
    raw, size = np.concatenate(raw), np.concatenate(size)
    start = np.cumsum(size) - size
    ids, at = learn(v, raw, start[where], (start + size)[where])
    known = np.concatenate([v.known, every])
    order = np.argsort(known, kind="stable")
    v.flat, v.flat_at = _gather(np.concatenate([v.flat, ids]), np.concatenate([v.flat_at, v.flat_at[-1] + at[1:]]), order)
    v.known, v.long = known[order], np.union1d(v.long, every[size[where] > KEEP])


def encode_all(v: Vocabulary, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each column: ids of all texts side by side, and n + 1 places where each text's begin."""
    _meet(v, columns)
    for column in columns:
        h, _, _, _, first = _hashed(column)
        ids, begin = _gather(v.flat, v.flat_at, np.searchsorted(v.known, h))
        yield ids, begin[first]
    if len(v.long):
        stay = np.flatnonzero(~np.isin(v.known, v.long))
        v.flat, v.flat_at = _gather(v.flat, v.flat_at, stay)
        v.known, v.long = v.known[stay], v.long[:0]


def encode(v: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return next(iter([*encode_all(v, [column])]))


def decode(v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts side by side, and where each begins; the space put before each text is gone."""
    body, at = _gather(v.piece_bytes, v.piece_at, ids.astype(np.int64))
    at = at[begin]
    full = at[1:] > at[:-1]
    keep = np.ones(len(body), bool)
    keep[at[:-1][full]] = False
    return body[keep], at - np.concatenate([[0], np.cumsum(full)])


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """keep columns, n_tokens, token_ids, and round_trip: whether decoding gives the text again."""
    v = load(model)
    read = docs.select(*keep) if text in keep else docs.select(*keep, text)
    fields = docs.select(*keep).schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            where = batch.schema.get_field_index(text)
            cut = [batch.slice(lo, hi - lo) for lo, hi in batches.pieces(batch, text, PIECE)]
            columns = [part.column(where) for part in cut]
            for part, column, (ids, begin) in zip(cut, columns, (x for k in range(0, len(columns), TOGETHER) for x in encode_all(v, columns[k : k + TOGETHER])), strict=True):
                body, at = decode(v, ids, begin)
                was, was_at = batches.string_bytes(column)
                same = (np.diff(at) == np.diff(was_at)).copy()
                if len(body) == len(was) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(body != was)])
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    for k in np.flatnonzero(same):
                        same[k] = np.array_equal(body[at[k] : at[k + 1]], was[was_at[k] : was_at[k + 1]])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(np.diff(begin)), batches.list_array(ids, begin, pa.int32()), pa.array(same)], names=[*keep, "n_tokens", "token_ids", "round_trip"])

    return read.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, token_ids array<int>, round_trip boolean")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether they decode to the text."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
