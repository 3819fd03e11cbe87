"""SentencePiece encoding and decoding by a streaming Viterbi search.

Text is fed to a lattice of the model's pieces. Each boundary keeps a back pointer to
the boundary its best path comes from. Pieces are at most ``longest`` characters, so
only paths that end in the last ``longest`` boundaries can go on; as soon as all of
them run through one boundary, the ids before it are committed and dropped.

For a unigram model the best path has the highest sum of scores, ties going to the
longer last piece. For a BPE model a piece may follow another only if merging the two
by rank gives the two back; the path that keeps to this is the one the merges give, so
the ids are those of the merge algorithm. Where no piece spans two neighbouring
characters every path has a boundary, so text is cut there and what the search gave
for a stretch is remembered by the worker. Short stretches are searched many at a time:
their lattices grow by one boundary at once, as arrays.

Cases: a null or empty text has no ids; a character without a piece becomes byte
pieces if the model has them, else the unknown id (one for a run); texts are encoded
whole; a repeated row gets its own result; extra columns pass through, and those named
like a result give way to it. Decoding gives the text back, but that U+2581 becomes a
space, as the format has it, and unknown ids become U+2047.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

from earshot.llm import arrow
from earshot.llm.memo import Memo

SPACE = "▁"
MAX_PAIRS = 150_000
#: Stretches of up to so many characters are searched together, about so many characters at a time.
SHORT = 64
TOGETHER = 1 << 16
#: Slots for what arrays of pairs gave, two to the power of this.
PAIR_BITS = 18
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _load(path: str) -> model_format.ModelProto:
    proto = model_format.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


class Decoder:
    """The bytes of each id."""

    def __init__(self, path: str):
        proto = _load(path)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.raw, byte = [], 0
        for piece in proto.pieces:
            if piece.type == _BYTE:
                self.raw.append(bytes([byte]))
                byte += 1
            elif piece.type == _UNKNOWN:
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.piece.replace(SPACE, " ").encode() if piece.type == _NORMAL else b"")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Pieces:
    """The pieces of a model file, as a trie, with what the lattice asks about them."""

    def __init__(self, path: str):
        proto = _load(path)
        form = proto.normalizer_spec
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces:
            raise ValueError("only models that leave the text as it is can be read")
        kinds = {p.type for p in proto.pieces}
        if not kinds <= {_NORMAL, _UNKNOWN, 3, _BYTE} or proto.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("user-defined or unused pieces, word and character models can't be read")
        self.prefix = form.add_dummy_prefix
        self.merges = proto.trainer_spec.model_type == _BPE
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
        self.bytes = [i for i, p in enumerate(proto.pieces) if p.type == _BYTE]
        self.least = min(self.score[i] for i in self.ids.values()) - 10
        self.longest = max(map(len, self.ids))
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.halves: dict[int, tuple[int, int]] = {}
        #: What is known of pairs, by left << 20 | right.
        self.pairs: dict[int, bool] = {}
        usable = self.ids
        if self.merges:
            usable = {p: i for p, i in self.ids.items() if self._merged(p) == i}
        #: From a character to what may follow it and the piece that ends there (or None).
        self.trie: dict[str, list] = {}
        for piece, i in usable.items():
            here, entry = self.trie, []
            for char in piece:
                entry = here.setdefault(char, [{}, None])
                here = entry[0]
            entry[1] = i

    def _merged(self, piece: str) -> int | None:
        """The id merging gives for a piece alone, remembering its last merge; or None."""
        parts = [self.ids.get(c, -1) for c in piece]
        while len(parts) > 1:
            options = [
                (-self.score[whole], at, whole)
                for at in range(len(parts) - 1)
                if parts[at] >= 0 <= parts[at + 1]
                and (whole := self.ids.get(self.text[parts[at]] + self.text[parts[at + 1]])) is not None
            ]
            if not options:
                return None
            _, at, whole = min(options)
            self.halves.setdefault(whole, (parts[at], parts[at + 1])) if len(parts) == 2 else None
            parts[at:at + 2] = [whole]
        return parts[0]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging two pieces side by side leaves them as they are.

        Their merges are undone from the last to the first. If ever the pieces at the
        seam could have merged before the merge just undone, they would have.
        """
        known = self.pairs.get(left << 20 | right)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 20 | right] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        rank = lambda i: -self.score[i]
        bound, or_equal = float("inf"), False
        while True:
            whole = self.ids.get(self.text[left] + self.text[right])
            if whole is not None and (rank(whole) < bound or or_equal and rank(whole) == bound):
                return False
            undo_left, undo_right = left in self.halves, right in self.halves
            if undo_left and (not undo_right or rank(left) > rank(right)):
                bound, or_equal, left = rank(left), False, self.halves[left][1]
            elif undo_right:
                bound, or_equal, right = rank(right), True, self.halves[right][0]
            else:
                return True


class Stream:
    """The lattice over a stream of characters; ``ids`` grows as paths converge."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ids: list[int] = []
        self.held = 0
        self._start()

    def _start(self) -> None:
        self.text = ""
        self.done = 0
        #: For each boundary of the window: sum of scores, boundary before, piece (below 0: a character).
        self.nodes: list[tuple[float, int, int] | None] = [(0.0, -1, -1)]
        self.last: int | None = None

    def feed(self, text: str) -> None:
        """Take more text. Its last ``longest`` characters wait for what may follow."""
        if len(self.text) + len(text) <= self.pieces.longest:
            self.text += text
            return
        step = 4 * self.pieces.longest
        for at in range(0, len(text), step):
            self.text += text[at:at + step]
            self._extend(len(self.text) - self.pieces.longest)
            self._commit()

    def finish(self) -> list[int]:
        self._extend(len(self.text))
        self._trace(len(self.text))
        self._start()
        return self.ids

    def _extend(self, upto: int) -> None:
        """Push every path on from boundaries below ``upto``."""
        pieces, text, nodes = self.pieces, self.text, self.nodes
        nodes.extend([None] * (len(text) + 1 - len(nodes)))
        merges, trie, pairs, end = pieces.merges, pieces.trie, pieces.pairs, len(text)
        for start in range(self.done, upto):
            here = nodes[start]
            if here is None:
                continue
            score, _, before = here
            if start == 0:
                before = self.last if self.last is not None else -1
            follow, at = trie, start
            single = False
            while at < end:
                entry = follow.get(text[at])
                if entry is None:
                    break
                at += 1
                follow, piece = entry
                if piece is None:
                    continue
                if at == start + 1:
                    single = True
                if merges:
                    if nodes[at] is None:
                        fits = before < 0 or pairs.get(before << 20 | piece)
                        if fits or fits is None and pieces.may_follow(before, piece):
                            nodes[at] = (0.0, start, piece)
                else:
                    total = score + pieces.score[piece]
                    if nodes[at] is None or total > nodes[at][0]:
                        nodes[at] = (total, start, piece)
            if not single:
                total = score + pieces.least
                if nodes[start + 1] is None or not merges and total > nodes[start + 1][0]:
                    nodes[start + 1] = (total, start, -1)
        self.done = max(self.done, upto)

    def _commit(self) -> None:
        """Commit what all paths that can go on have in common."""
        ends = [i for i in range(self.done, len(self.nodes)) if self.nodes[i] is not None]
        meets = set(ends)
        while len(meets) > 1:
            latest = max(meets)
            meets.discard(latest)
            meets.add(self.nodes[latest][1])
        self.held = max(self.held, len(self.text))
        if meets and (to := meets.pop()) > 0:
            self._trace(to)
            base = self.nodes[to][0]
            self.last = self.nodes[to][2]
            self.nodes = [(0.0, -1, -1)] + [
                None if n is None or n[1] < to else (n[0] - base, n[1] - to, n[2]) for n in self.nodes[to + 1:]
            ]
            self.text = self.text[to:]
            self.done -= to

    def _trace(self, to: int) -> None:
        path = []
        while to > 0:
            _, back, piece = self.nodes[to]
            path.append((piece, self.text[back:to]))
            to = back
        for piece, surface in reversed(path):
            if piece >= 0:
                self.ids.append(piece)
            elif self.pieces.bytes:
                self.ids.extend(self.pieces.bytes[b] for b in surface.encode("utf-8", "surrogatepass"))
            elif not self.ids or self.ids[-1] != self.pieces.unknown:
                self.ids.append(self.pieces.unknown)


class Lookup:
    """Whole numbers (0 or more) by keys (0 or more), for arrays of keys; -1 for other keys."""

    def __init__(self, table: dict[int, int]):
        self.shift = np.uint64(64 - max(4, (2 * len(table)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int32)
        keys, values = np.fromiter(table.keys(), np.int64), np.fromiter(table.values(), np.int32)
        slots = slots_of(keys, self.shift)
        while keys.size:
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & (len(self.keys) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = slots_of(keys, self.shift)
        there = self.keys[slots]
        out = self.values[slots]
        wrong = np.flatnonzero(there != keys)
        out[wrong] = -1
        wrong = wrong[there[wrong] >= 0]
        while wrong.size:
            slots[wrong] = (slots[wrong] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[wrong]]
            right = there == keys[wrong]
            out[wrong[right]] = self.values[slots[wrong[right]]]
            wrong = wrong[~right & (there >= 0)]
        return out


def slots_of(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64)


class Lattices:
    """The lattices of many short stretches side by side, for models with byte pieces."""

    #: Follows the last character of a stretch; no code point.
    _END = 0x1FFFFF

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        edges, ends, queue = {}, [-1], [(0, pieces.trie)]
        for state, follow in queue:
            for char, (below, piece) in follow.items():
                edges[state << 21 | ord(char)] = len(ends)
                queue.append((len(ends), below))
                ends.append(-1 if piece is None else piece)
        self.edges, self.ends = Lookup(edges), np.array(ends, np.int32)
        self.score = np.array(pieces.score)
        self.bytes = np.array(pieces.bytes, np.int32)
        if pieces.merges:
            ids = pieces.ids
            self.wholes = Lookup({
                ids[p[:i]] << 20 | ids[p[i:]]: whole
                for p, whole in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids
            })
            self.halves = np.full((len(pieces.text), 2), -1, np.int64)
            for whole, parts in pieces.halves.items():
                self.halves[whole] = parts
            self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
            self.pair_holds = np.zeros(1 << PAIR_BITS, bool)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Pieces.may_follow`` for arrays; a slot remembers the last pair that fell into it."""
        keys = left << 20 | right
        slots = slots_of(keys, np.uint64(64 - PAIR_BITS))
        holds = self.pair_holds[slots]
        new = np.flatnonzero(self.pairs[slots] != keys)
        if new.size:
            first, back = np.unique(keys[new], return_inverse=True)
            found = self._hold(first >> 20, first & 0xFFFFF)
            holds[new] = found[back]
            # One pair for each slot, so that key and answer belong together.
            taken, at = np.unique(slots_of(first, np.uint64(64 - PAIR_BITS)), return_index=True)
            self.pairs[taken], self.pair_holds[taken] = first[at], found[at]
        return holds

    def _hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        holds = np.ones(len(left), bool)
        live = np.arange(len(left))
        bound, or_equal = np.full(len(left), np.inf), np.zeros(len(left), bool)
        while live.size:
            whole = self.wholes(left << 20 | right)
            rank = -self.score[whole]
            clash = (whole >= 0) & ((rank < bound) | or_equal & (rank == bound))
            holds[live[clash]] = False
            inner_left, inner_right = self.halves[left, 1], self.halves[right, 0]
            undo_left = (inner_left >= 0) & ((inner_right < 0) | (self.score[left] < self.score[right]))
            on = np.flatnonzero(~clash & ((inner_left >= 0) | (inner_right >= 0)))
            bound = np.where(undo_left, -self.score[left], -self.score[right])[on]
            left, right = np.where(undo_left, inner_left, left)[on], np.where(undo_left, right, inner_right)[on]
            live, or_equal = live[on], ~undo_left[on]
        return holds

    def encode(self, texts: list[str]) -> list[bytes]:
        """What ``Stream`` gives for each text, as bytes."""
        out = [b""] * len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        by_length = np.argsort(lengths, kind="stable")
        groups = np.cumsum(lengths[by_length]) // TOGETHER
        for some in np.split(by_length, np.flatnonzero(np.diff(groups)) + 1):
            some = some.tolist()
            for i, part in zip(some, self._search([texts[i] for i in some]) if some else []):
                out[i] = part
        return out

    def _search(self, texts: list[str]) -> list[bytes]:
        lengths = np.array([len(t) for t in texts])
        inside = np.arange(lengths.max() + 1) < lengths[:, None]
        chars = np.full(inside.shape, self._END, np.int64)
        chars[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        piece, back = self._extend(np.ascontiguousarray(chars.T))
        return self._trace(piece, back, chars, lengths)

    def _steps(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in the texts: boundary before, boundary after, id. Characters without a piece have -1.

        Boundary ``b`` of text ``t`` is numbered ``b * texts + t``; steps are in that order of ``b`` before.
        """
        texts, flat = chars.shape[1], chars.ravel()
        start = here = np.flatnonzero(flat != self._END)
        state = np.zeros(len(start), np.int64)
        loose = np.ones(len(flat), bool)
        steps = []
        while here.size:
            state = self.edges(state << 21 | flat[here])
            on = np.flatnonzero(state >= 0)
            start, here, state = start[on], here[on] + texts, state[on].astype(np.int64)
            piece = self.ends[state]
            is_piece = np.flatnonzero(piece >= 0)
            if not steps:
                loose[start[is_piece]] = False
            steps.append((start[is_piece], here[is_piece], piece[is_piece]))
        alone = np.flatnonzero(loose & (flat != self._END))
        steps.append((alone, alone + texts, np.full(len(alone), -1)))
        start, end, piece = map(np.concatenate, zip(*steps))
        order = np.argsort((start // texts).astype(np.uint16), kind="stable")
        return start[order], end[order], piece[order].astype(np.int64)

    def _extend(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each boundary: last piece of the best path (-1 a character, -2 no path), boundary before it."""
        texts, wide = chars.shape[1], len(chars) - 1
        start, end, piece = self._steps(chars)
        last, back = np.full(chars.size, -2, np.int64), np.zeros(chars.size, np.int64)
        last[:texts] = -1
        total = np.full(chars.size, -np.inf)
        total[:texts] = 0
        bounds = np.searchsorted(start // texts, np.arange(wide + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            # From one boundary of a text no two steps end in the same.
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.pieces.merges:
                fits = (last[e] == -2) & (last[s] > -2)
                asked = np.flatnonzero(fits & (last[s] >= 0) & (p >= 0))
                fits[asked] = self.may_follow(last[s[asked]], p[asked])
            else:
                sums = total[s] + np.where(p >= 0, self.score[p], self.pieces.least)
                fits = sums > total[e]
                total[e[fits]] = sums[fits]
            last[e[fits]], back[e[fits]] = p[fits], s[fits]
        return last, back

    def _trace(self, last: np.ndarray, back: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        texts = len(lengths)
        at = lengths * texts + np.arange(texts)
        chosen = np.full(chars.size, -2, np.int32)
        while (at := at[at >= texts]).size:
            chosen[back[at]] = last[at]
            at = back[at]
        chosen = chosen.reshape(chars.T.shape).T
        on_path = chosen > -2
        ids, sizes = chosen[on_path], on_path.astype(np.int64)
        if (loose := ids < 0).any():
            code = chars[on_path]
            size = np.where(loose, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
            raw = code[loose].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids, sizes[on_path] = np.repeat(ids, size), size
            ids[ids < 0] = self.bytes[np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)]
        ends = np.cumsum(4 * sizes.sum(axis=1)).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Whole texts to ids, by way of the stretches between forced boundaries.

    What it remembers lives as long as it does, which is one task.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        own = weakref.proxy(self)  # in no cycle, so that the tables go when the encoder does
        self.words = Memo(lambda words: own._words(words), 12 << 20)
        self.stretches = Memo(lambda texts: own._stretches(texts), 2 << 20)
        self.lattices = lattices_of(pieces) if pieces.bytes else None
        self._cut = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.pieces.cuts_at_space else None

    def _search(self, text: str) -> bytes:
        stream = Stream(self.pieces)
        stream.feed(text)
        return np.array(stream.finish(), np.int32).tobytes()

    def _by_length(self, texts: list[str], longer: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Short texts by the lattices, the others by ``longer``."""
        short = [t for t in texts if len(t) <= SHORT]
        found = self.lattices.encode(short)
        if len(short) == len(texts):
            return found
        long = iter(longer([t for t in texts if len(t) > SHORT]))
        rest = iter(found)
        return [next(rest if len(t) <= SHORT else long) for t in texts]

    def _stretches(self, texts: list[str]) -> list[bytes]:
        return self._by_length(texts, lambda long: list(map(self._search, long)))

    def _words(self, words: list[str]) -> list[bytes]:
        if not self.pieces.bytes:  # a run of unknown characters has one id, also across a cut
            return list(map(self._search, words))
        return self._by_length(words, self._cut_words)

    def _cut_words(self, words: list[str]) -> list[bytes]:
        inside = self.pieces.inside
        cut = []
        for word in words:
            at, parts = 0, []
            for i in range(1, len(word)):
                if word[i - 1:i + 1] not in inside:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            cut.append(parts)
        return self.stretches.join_all(cut)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        ready = [(SPACE if self.pieces.prefix and t else "") + t.replace(" ", SPACE) for t in texts]
        return self.words.join_all([self._cut.findall(t) if self._cut else [t] * bool(t) for t in ready])


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=1)
def lattices_of(pieces: Pieces) -> Lattices:
    return Lattices(pieces)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(
    docs: DataFrame, model: str, text: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each text (array of int), and if asked for with what they decode to."""

    def make():
        held = Encoder(pieces_of(model))
        back = decoder(model) if decoded else None

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = held.encode(arrow.strings(batch.column(text)))
            ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            found = [pa.ListArray.from_arrays(pa.array(ends), values)]
            if back:
                found.append(pa.array([back.decode(np.frombuffer(p, np.int32)) for p in parts], pa.string()))
            return found

        return work

    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))]
    return arrow.map_columns(docs, fields + ([T.StructField(decoded, T.StringType())] if decoded else []), make)


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids; null counts as no ids."""

    def make():
        held = decoder(model)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(ids)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths)])
            return [pa.array([held.decode(values[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string())]

        return work

    return arrow.map_columns(docs, [T.StructField(out, T.StringType())], make)
