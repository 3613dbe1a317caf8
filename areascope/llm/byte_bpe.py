"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

The merges (a rank file) are compiled into a trie of the tokens and a test
whether one token may follow another: t may follow s if the merges, applied to
the bytes of s and t together, end with exactly s and t. A sequence of tokens
is what the merges make of its bytes if and only if each of its tokens may
follow the one before it, since the first merge that crosses a border in the
whole sequence would cross it in the pair as well. So every prefix of a match
has one last token, and reading a byte moves a set of hypotheses: where the
open token starts, and which tokens were chosen before it and are not emitted
yet. Such a set is a state of the determinised transducer; states and their
moves are made when a text first needs them, in each worker. What all
hypotheses agree on is emitted at once, so no more than a bounded lookahead
is ever held back, and the time grows with the bytes of a match, also of very
long ones.

Decoding moves an incremental UTF-8 machine by whole tokens: its state is the
beginning of a character that the tokens so far leave unfinished.

Defined results: null and empty texts have no ids, and ids null decode like
none; all columns asked for are passed through whatever their names; repeated
rows are encoded each for itself; an empty table gives an empty table. Texts
of any length are worked through match by match. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import codecs
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import regex
from pyspark.sql import DataFrame

from .common import flat_map_rows, schema_of

#: What a worker keeps at most, under 300 MB together: states, token pairs tested, short matches with their ids (twice as
#: many). Beyond, what is full is forgotten and made anew as needed.
MAX_STATES, MAX_PAIRS, MAX_MATCHES = 300_000, 300_000, 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token -> rank of a rank file: a base64 token and its rank on each line."""
    ranks = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Transducer:
    """Encoder for one set of ranks and one splitting pattern; each match of the pattern is encoded by itself.

    A state is packed as the token emitted last (-1: none, or of no use) and the hypotheses by start of the open token:
    trie node, number of tokens held, these tokens. The last hypothesis is at the root of the trie: nothing is open,
    and what it holds is what is left to emit if the match ends here. State 0 is the start. ``_moves`` maps state and
    byte to the next state and the tokens emitted, packed; ``_ends`` has the last tokens of states in which matches ended.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._four = {rank: rank.to_bytes(4, "little") for rank in self.bytes_of}
        self._child, self._token, self._inner = {}, [-1], {0}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._inner.add(node)
                key = node << 8 | byte
                nxt = self._child.get(key)
                if nxt is None:
                    nxt = self._child[key] = len(self._token)
                    self._token.append(-1)
                node = nxt
            self._token[node] = rank
        self._pairs: dict[int, bool] = {}
        self._spines: dict[tuple, list | None] = {}
        self._matches: dict[str, bytes] = {}  # the latest
        self._before: dict[str, bytes] = {}  # those before them
        self._forget()

    def _forget(self) -> None:
        self._moves, self._ends, self._forms = {}, {}, [array("i", [-1, 0, 0]).tobytes()]
        self._ids = {self._forms[0]: 0}

    # -- what may follow what --

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges applied to a few bytes, lowest rank first, from the left, down to ``least`` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > least:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list | None:
        """The pieces at one edge of a token while it is merged, last first: (piece, rank that made it, rank that used it).

        None if the merges don't make the token. Single bytes are there from the start.
        """
        key = (token, right)
        if key not in self._spines:
            piece, used, out = self.bytes_of[token], 1 << 62, []
            if self.merge(piece) != [piece]:
                out = None
            while out is not None:
                made = self.ranks[piece] if len(piece) > 1 else -1
                out.append((piece, made, used))
                if len(piece) == 1:
                    break
                piece, used = self.merge(piece, 2)[1 if right else 0], made
            self._spines[key] = out
        return self._spines[key]

    def follows(self, first: int, second: int) -> bool:
        """Whether ``second`` may come after ``first`` (-1: whether it may come first).

        Goes back in time through the pieces at the border: whenever two of them met, did a merge across the border
        come before the merges that used them otherwise? Of equal ranks the left merge comes first.
        """
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is not None:
            return known
        after = self._spine(second, False)
        known = after is not None
        if known and first >= 0:
            before, i, j = self._spine(first, True), 0, 0
            while True:
                (x, made_x, used_x), (y, made_y, used_y) = before[i], after[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < used_x and rank <= used_y:
                    known = False
                    break
                if made_x < 0 and made_y < 0:
                    break
                if made_x > made_y:
                    i += 1
                else:
                    j += 1
        if len(self._pairs) >= MAX_PAIRS:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    # -- states and moves --

    def _move(self, state: int, byte: int) -> tuple:
        """Makes the move that was never met before."""
        form = array("i")
        form.frombytes(self._forms[state])
        last, opened, done, at, child = form[0], [], None, 1, self._child
        while at < len(form):
            end = at + 2 + form[at + 1]
            node = child.get(form[at] << 8 | byte)
            if node is not None:
                held = form[at + 2:end]
                token = self._token[node]
                if done is None and token >= 0 and self.follows(held[-1] if held else last, token):
                    done = held + array("i", [token])
                if node in self._inner:
                    opened.append((node, held))
            at = end
        opened.append((0, done))
        common = 0
        shortest = min(len(held) for _, held in opened)
        while common < shortest and all(held[common] == done[common] for _, held in opened):
            common += 1
        emit = done[:common]
        told = b"".join([self._four[t] for t in emit])
        # Where every hypothesis holds a token, nobody asks for the one before.
        form = array("i", [-1 if common < shortest else emit[-1] if emit else last])
        for node, held in opened:
            form.extend((node, len(held) - common))
            form.extend(held[common:])
        form = form.tobytes()
        nxt = self._ids.get(form)
        if nxt is None:
            if len(self._forms) >= MAX_STATES:
                self._forget()
                state = -1
            nxt = self._ids[form] = len(self._forms)
            self._forms.append(form)
        if state >= 0:
            self._moves[state << 8 | byte] = (nxt, told)
        return nxt, told

    def _rest(self, state: int) -> bytes:
        """What is left to emit if a match ends in this state."""
        form = array("i")
        form.frombytes(self._forms[state])
        at = 1
        while at + 2 + form[at + 1] < len(form):
            at += 2 + form[at + 1]
        rest = self._ends[state] = b"".join([self._four[t] for t in form[at + 2:]])
        return rest

    def pieces(self, match: bytes) -> Iterator[bytes]:
        """The packed tokens of one match, in the portions in which the transducer emits them."""
        state = 0
        for byte in match:
            state, emit = self._moves.get(state << 8 | byte) or self._move(state, byte)
            if emit:
                yield emit
        yield self._rest(state)

    def _run(self, part: str) -> bytes:
        """The packed ids of one match that is not among the latest."""
        known = self._before.get(part)
        if known is not None:
            self._matches[part] = known
            return known
        state, ids, move = 0, [], self._moves.get
        for byte in part.encode("utf-8", "surrogatepass"):
            found = move(state << 8 | byte)
            if found is None:
                found = self._move(state, byte)
                move = self._moves.get
            state, emit = found
            if emit:
                ids.append(emit)
        rest = self._ends.get(state)
        ids.append(self._rest(state) if rest is None else rest)
        ids = b"".join(ids)
        if len(part) <= 32:
            if len(self._matches) >= MAX_MATCHES:
                self._before, self._matches = self._matches, {}
            self._matches[part] = ids
        return ids

    def _split(self, text: str) -> Iterator[list]:
        """The matches, many at a time."""
        if len(text) <= 1 << 20:
            yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while some := [m.group() for m in islice(matches, 1 << 16)]:
            yield some

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers; those of short matches are looked up again."""
        out = []
        for parts in self._split(text):
            ids = list(map(self._matches.get, parts))
            if None in ids:
                ids = [self._run(part) if known is None else known for part, known in zip(parts, ids)]
            out.append(b"".join(ids))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        out = array("I", self.packed(text))
        if sys.byteorder == "big":
            out.byteswap()
        return out


class _Partial(dict):
    """token -> (next state, text) of the UTF-8 machine in one state: ``head`` is the unfinished character."""

    __slots__ = ("machine", "head")

    def __init__(self, machine: Utf8Machine, head: bytes):
        super().__init__()
        self.machine, self.head = machine, head

    def __missing__(self, token: int) -> tuple:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        text = decoder.decode(self.head + self.machine.bytes_of[token])
        move = self[token] = self.machine.state(decoder.getstate()[0]), text
        return move


class Utf8Machine:
    """Streaming decoder: ids come in any portions, whole characters go out as soon as they are complete.

    Bytes that cannot be part of a character become U+FFFD, as does an unfinished character at the end. There are as
    many states as beginnings of characters that tokens leave, and each learns its moves as tokens are met.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self._states = bytes_of, {}

    def state(self, head: bytes) -> _Partial:
        found = self._states.get(head)
        if found is None:
            found = self._states[head] = _Partial(self, head)
        return found

    def decode(self, portions: Iterable[Iterable[int]]) -> Iterator[str]:
        state = self.state(b"")
        for ids in portions:
            out = []
            for token in ids:
                state, text = state[token]
                out.append(text)
            yield "".join(out)
        if state.head:
            yield state.head.decode("utf-8", "replace")


class _Worker:
    """The compiled forms, made once in each Python worker for a broadcast rank file."""

    made: dict = {}

    @classmethod
    def of(cls, kind: str, shared, pattern: str | None = None):
        key = (kind, shared.value, pattern)
        if key not in cls.made:
            ranks = read_ranks(shared.value)
            cls.made = {k: v for k, v in cls.made.items() if k[1] == shared.value}
            cls.made[key] = (Transducer(ranks, pattern) if kind == "encode"
                             else Utf8Machine({rank: token for token, rank in ranks.items()}))
        return cls.made[key]


def _share(df: DataFrame, ranks: bytes | str):
    """Broadcasts a rank file (under 1 MB for 50,000 tokens), given by its bytes or its path on the driver."""
    if isinstance(ranks, str):
        with open(ranks, "rb") as file:
            ranks = file.read()
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, keep: list[str], ranks: bytes | str, pattern: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``: the tokens of the whole text as little-endian unsigned 32-bit numbers.

    ``ranks`` is a rank file or its path; ``pattern`` splits texts into the stretches that are encoded separately.
    """
    shared = _share(docs, ranks)

    def run(*values) -> Iterator[tuple]:
        *kept, content = values
        fst = _Worker.of("encode", shared, pattern)
        yield (*kept, fst.packed(content) if content else b"")

    return flat_map_rows(docs.select(*keep, text), run, schema_of(docs, keep, "ids binary"))


#: Ids that the decoder takes at a time.
_PORTION = 1 << 16


def decode(encoded: DataFrame, keep: list[str], ranks: bytes | str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``text``: the text of the packed ids, decoded portion by portion."""
    shared = _share(encoded, ranks)

    def run(*values) -> Iterator[tuple]:
        *kept, packed = values
        machine = _Worker.of("decode", shared)
        found = array("I", packed or b"")
        if sys.byteorder == "big":
            found.byteswap()
        view = memoryview(found)
        yield (*kept, "".join(machine.decode(view[i:i + _PORTION] for i in range(0, len(found), _PORTION))))

    return flat_map_rows(encoded.select(*keep, ids), run, schema_of(encoded, keep, "text string"))
