"""Encoding of whole texts with a byte-level BPE tokenizer, and its inverse.

Method. A transducer reads a text once. Words are cut off block by block as soon as the
pre-tokenizer's pattern can no longer change them. Inside a word the state after each byte is the
last token of that prefix's encoding: an automaton over the vocabulary names the tokens that end
there, and token ``t`` may follow token ``s`` exactly if no merge crosses the border between them
while each is being built. A merge list moves a border only through a chain of merges of falling
priority, so a token is stable, and emitted, once :meth:`Transducer.lookahead` bytes have followed
it. What is held is a block of text and two lookaheads of bytes, however long text and words are
(:meth:`Transducer.encode_stream`). The ids of words met before are remembered; what is remembered
is the transducer's own output, so this saves time only.

Decoding feeds the bytes of each id to an incremental UTF-8 state machine that keeps at most three
bytes of an unfinished character.

Scale. One narrow map: no shuffle, one row in and one row out, whole texts; vocabulary files are
read once on the driver (about 1 MB) and sent to the tasks.

Defined results. A null or an empty text has the ids ``[]``. The strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files are; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text looked at together, 6 at least; changes no result.
BLOCK = 1 << 16
#: Remembered words; the memory is emptied when full, which changes no result.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """``(bytes of each id, merges as (left id, right id, new id))`` of ``<folder>/<name>.json``."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, ids = byte_letters(), model["vocab"]
    tokens = [b""] * (max(ids.values()) + 1)
    for text, at in ids.items():
        tokens[at] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


class _Feed:
    """A text given in pieces, of which about a block is held."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.text = iter(pieces), ""
        self.next = next(self.pieces, None)

    @property
    def ended(self) -> bool:
        return self.next is None

    def fill(self) -> bool:
        while self.next is not None and len(self.text) < BLOCK:
            self.text += self.next
            self.next = next(self.pieces, None)
        return bool(self.text)

    def take(self, end: int) -> str:
        out, self.text = self.text[:end], self.text[end:]
        return out


class Transducer:
    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        import ahocorasick
        import regex

        self.tokens, self.merges = tokens, merges
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
        self.of_byte = [0] * 256
        for at, t in enumerate(tokens):
            if len(t) == 1:
                self.of_byte[t[0]] = at
        #: of each token its first and last part on the way from bytes, with the rank of the merge that takes the part
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at in self.of_byte:
            self.left[at] = self.right[at] = []
            found.add_word(tokens[at].decode("latin-1"), at)
        for k, (a, b, c) in enumerate(merges):
            if a not in self.left or b not in self.left or c in self.left:
                raise ValueError("every token must be made by one merge of tokens made before")
            self.left[c] = [*self.left[a], (a, k)]
            self.right[c] = [*self.right[b], (b, k)]
            found.add_word(tokens[c].decode("latin-1"), c)
        found.make_automaton()
        self.automaton = found
        self.reach = self.lookahead()
        self.pattern = regex.compile(PATTERN)
        # how a run of blanks, letters, numbers or other marks starts, and how it goes on
        self.runs = [tuple(map(regex.compile, p)) for p in ((r"\s{2,}", r"\s+"), (r" ?\p{L}+", r"\p{L}+"), (r" ?\p{N}+", r"\p{N}+"), (r" ?[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]+"))]
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def lookahead(self) -> int:
        """Bytes after which a token can no longer change.

        A new byte acts to the left only through a chain of merges of rising rank, each taking as
        its right part the left part of the one before; the longest chain times the longest token
        bounds its reach.
        """
        by_left: dict[int, int] = {}
        most = 1
        for a, b, _ in self.merges:
            here = 1 + by_left.get(b, 0)
            if here > by_left.get(a, 0):
                by_left[a] = here
            most = max(most, here)
        return (most + 1) * max(map(len, self.tokens))

    def follows(self, s: int, t: int) -> bool:
        """Whether ``t`` may stand after ``s``: no merge takes parts of both while they are built.

        The part at the end of ``s`` and the one at the start of ``t`` grow merge by merge; two of
        them that stand side by side are merged if that comes before both are taken by others. At
        equal ranks the leftmost merge comes first.
        """
        known = self.pairs.get((s, t))
        if known is not None:
            return known
        never = len(self.merges)
        ends, starts = [*self.right[s], (s, never)], [*self.left[t], (t, never)]
        i = j = 0
        known = True
        while True:
            (a, a_goes), (b, b_goes) = ends[i], starts[j]
            k = self.rank.get((a, b), never)
            if k < a_goes and k <= b_goes and k < never:
                known = False
                break
            if a_goes == b_goes == never:
                break
            # taken at the same rank: both are
            i, j = i + (a_goes <= b_goes), j + (b_goes <= a_goes)
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        self.pairs[s, t] = known
        return known

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word given in parts, each emitted once stable."""
        last: list[int] = [-1]  # last[k]: last token of the encoding of the first k bytes since the last emitted token
        base = 0  # bytes emitted
        before = -1  # the last emitted token
        tokens, follows = self.tokens, self.follows
        search = self.automaton.iter("")
        for part in parts:
            search.set(part.decode("latin-1"))
            for end, token in search:
                # tokens that end here come longest first; one of them is right
                at = end + 1 - base
                if at < len(last):
                    continue
                start = at - len(tokens[token])
                if start < 0:
                    continue
                left = last[start] if start else before
                if left < 0 or follows(left, token):
                    last.append(token)
                    if at >= 2 * self.reach:
                        emitted = self._chain(last, at, at - self.reach)
                        yield from emitted
                        cut = sum(len(tokens[t]) for t in emitted)
                        base, before, last = base + cut, emitted[-1], [-1, *last[cut + 1 :]]
        yield from self._chain(last, len(last) - 1, len(last))

    def _chain(self, last: list[int], at: int, stable: int) -> list[int]:
        """The tokens on the way to ``at`` that end at ``stable`` or before."""
        out = []
        while at > 0:
            if at <= stable:
                out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def _cut(self, pieces: Iterable[str]) -> Iterator[list[str] | Iterator[str]]:
        """The words of a text given in pieces, a block at a time; one longer than a block comes as its parts.

        Parts must be used up before more is asked for.
        """
        feed = _Feed(pieces)
        while feed.fill():
            if feed.ended:
                yield self.pattern.findall(feed.take(len(feed.text)))
                continue
            words, at = [], 0
            for match in self.pattern.finditer(feed.text):
                # the pattern looks at most two characters ahead
                if match.end() + 2 >= len(feed.text):
                    break
                at = match.end()
                words.append(match.group())
            if at:
                feed.take(at)
                yield words
            else:
                kind = next(k for k, (head, _) in enumerate(self.runs) if head.match(feed.text))
                yield self._parts(feed, *self.runs[kind], spaces=kind == 0)

    @staticmethod
    def _parts(feed: _Feed, head, run, spaces: bool) -> Iterator[str]:
        """The run of like characters that ``feed`` starts with."""
        over = False
        while not over:
            match = head.match(feed.text)
            end = match.end() if match else 0
            over = feed.ended or end < len(feed.text)
            if spaces and not (feed.ended and end == len(feed.text)):
                # the last blank belongs to what follows, if anything does
                end -= 1
            if end > 0:
                yield feed.take(end)
            feed.fill()
            head = run

    def word(self, word: str) -> tuple[int, ...]:
        found = tuple(self.stream((word.encode("utf-8"),)))
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self.words[word] = found
        return found

    def encode_stream(self, pieces: Iterable[str]) -> Iterator[int]:
        """The ids of a text given in pieces of any size, in constant memory."""
        known = self.words
        for words in self._cut(pieces):
            if isinstance(words, list):
                for word in words:
                    yield from known.get(word) or self.word(word)
            else:
                yield from self.stream(p.encode("utf-8") for p in words)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.words
        for words in self._cut(_blocks(text)):
            if isinstance(words, list):
                for word in words:
                    out += known.get(word) or self.word(word)
            else:
                out += self.stream(p.encode("utf-8") for p in words)
        return out

    def count(self, text: str | None) -> int:
        known, total = self.words, 0
        for words in self._cut(_blocks(text)):
            if isinstance(words, list):
                total += sum([len(known.get(word) or self.word(word)) for word in words])
            else:
                total += sum(1 for _ in self.stream(p.encode("utf-8") for p in words))
        return total

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in ids:
            if piece := machine.decode(self.tokens[at]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece


def _blocks(text: str | None) -> Iterator[str]:
    return (text[k : k + BLOCK] for k in range(0, len(text or ""), BLOCK))


_made: dict[tuple, Transducer] = {}


def _transducer(key: tuple, shared) -> Transducer:
    """One transducer per Python worker and vocabulary."""
    if key not in _made:
        _made[key] = Transducer(*shared.value)
    return _made[key]


def _shared(df: DataFrame, name: str, folder: str):
    return (name, folder), df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))


def encode(df: DataFrame, text: str = "text", to: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``to``."""
    key, shared = _shared(df, name, folder)

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pd.Series) -> pd.Series:
        made = _transducer(key, shared)
        return pd.Series([made.encode(x) for x in texts], dtype=object)

    return df.withColumn(to, ids(text))


def count_tokens(df: DataFrame, text: str = "text", to: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``to``; 0 for null and empty texts."""
    key, shared = _shared(df, name, folder)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        made = _transducer(key, shared)
        return pd.Series([made.count(x) for x in texts], dtype="int32")

    return df.withColumn(to, count(text))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the text of ``ids`` in ``to``; null ids stay null."""
    key, shared = _shared(df, name, folder)

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        made = _transducer(key, shared)
        return pd.Series([None if x is None else "".join(made.decode(x)) for x in lists], dtype=object)

    return df.withColumn(to, text(ids))
