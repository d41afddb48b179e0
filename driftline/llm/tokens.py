"""Token ids of whole texts, by the public tokenizers. Files of the tokenizers are parameters; none is kept here."""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Collection
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import MEMO_WORDS

#: Chunks that the tokenizer gets in one text.
JOINED = 64


def cut(values: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls; to_pylist makes an object of Arrow for each of them first."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    body = values.buffers()[2].to_pybytes() if at[-1] else b""
    return [body[x:y] for x, y in itertools.pairwise(at)]


class Encoder(dict):
    """Maps a chunk of text to its ids as little-endian unsigned 32-bit integers, memoised.

    A text is cut only where the tokenizer itself would cut it, whatever stands on either side, so the ids of the chunks in a
    row are the ids of the text; the chunks repeat, so most of them are looked up, and the others of a batch go to the
    tokenizer together.
    """

    def __init__(self, path: str, most: int = 3 * MEMO_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.of, self.most = Tokenizer.from_file(path), most
        self.bounds = np.zeros(self.of.get_vocab_size(), bool)
        self.bounds[[i for token, i in self.of.get_vocab().items() if self.bound(token)]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    #: Whether ids that bound chunks are left out of them.
    SEPARATED = False

    def bound(self, token: str) -> bool:
        raise NotImplementedError

    def joined(self, chunks: list[bytes]) -> str:
        """Chunks as one text in which their ids can be told apart: every chunk begins with an id of `bounds`, or one stands between them."""
        raise NotImplementedError

    def learn(self, new: Collection[bytes]) -> None:
        """Puts different chunks that the memo lacks into it."""
        new = list(new)
        groups = [new[at : at + JOINED] for at in range(0, len(new), JOINED)]
        for group, e in zip(groups, self.of.encode_batch_fast([self.joined(g) for g in groups], add_special_tokens=False), strict=True):
            ids = array("I", e.ids)
            at = np.flatnonzero(self.bounds[np.frombuffer(ids, np.uint32)])
            starts, ends = (np.append(0, at + 1), np.append(at, len(ids))) if self.SEPARATED else (at, np.append(at[1:], len(ids)))
            if len(starts) != len(group):  # an odd chunk bounds others; each is encoded by itself
                self.update(zip(group, self.ids([self.joined([c]) for c in group]), strict=True))
                continue
            body = ids.tobytes()
            self.update(zip(group, [body[4 * x : 4 * y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))


    def looked_up(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of texts that are cut into chunks."""
        if len(self) > self.most:
            self.clear()
        found = [list(map(self.get, chunks)) for chunks in texts]
        lacking = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        self.learn({chunks[i] for chunks, at in zip(texts, lacking, strict=True) for i in at})
        for chunks, ids, at in zip(texts, found, lacking, strict=True):
            for i in at:
                ids[i] = self[chunks[i]]
        return list(map(b"".join, found))


class WordEncoder(Encoder):
    """For a tokenizer that drops white space and case: every run of bytes between ASCII white space is a chunk.

    Where one mark follows a letter and white space follows it, the mark is a chunk of its own, as the tokenizer has it. Texts
    with what may be a special token, whose case matters, are encoded whole.
    """

    MARK = re.compile(rb"(?<=[a-z])([.,;:!?])(?=\s|\Z)")

    #: A control character, which is an id of its own where it stands alone; texts that hold it are encoded whole.
    SEPARATED = True

    def bound(self, token: str) -> bool:
        return token == chr(256 + 2) + "</w>"

    def joined(self, chunks: list[bytes]) -> str:
        return b" \x02 ".join(chunks).decode()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        odd = [b"<|" in t or b"\x02" in t for t in texts]
        found = self.looked_up([[] if o else self.MARK.sub(rb" \1", t.lower()).split() for t, o in zip(texts, odd, strict=True)])
        return [self.ids([t.decode()])[0] if o else ids for t, o, ids in zip(texts, odd, found, strict=True)]


class ByteEncoder(Encoder):
    """For a byte-level tokenizer whose chunks are a space with what follows up to the next space, or a newline with what follows.

    A space before something other than white space always starts a chunk, and so does a newline between two other characters;
    the memo holds the former without the space. Marks at a chunk's end are ids of their own, so that a word is learnt once
    whatever mark follows it. Texts with other spaces, or with what may be a special token, are encoded whole.
    """

    #: A space before white space, ASCII or beyond, or at the end.
    SPACES = re.compile(rb" (?:[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
    MARKS = b".,;:!?"
    ENDS = tuple(bytes([m]) for m in MARKS)
    #: First bytes of characters beyond ASCII among which there is white space.
    WIDE = frozenset(b"\xc2\xe1\xe2\xe3")

    def __init__(self, path: str, most: int = 3 * MEMO_WORDS):
        super().__init__(path, most)
        self.of.model._resize_cache(0)  # the memo knows what repeats, so the library's own cache only costs time
        self.tails: dict[bytes, bytes] = {}
        self.newline = self.of.token_to_id("\u010a")

    def bound(self, token: str) -> bool:
        return token.startswith("\u0120")

    def joined(self, chunks: list[bytes]) -> str:
        return b" ".join([b"", *chunks]).decode()

    def whole(self, text: bytes) -> bool:
        return b"<|" in text or self.SPACES.search(text) is not None

    def edged(self, line: bytes) -> bool:
        """Whether a line begins or ends with what may be white space, or is empty."""
        if not line or line[0] <= 32 or line[0] in self.WIDE or line[-1] <= 32:
            return True
        return line[-1] > 127 and line[-4:].decode(errors="ignore")[-1:].isspace()

    def spaced(self, text: bytes) -> bytes:
        """The text with a space before every newline that starts a chunk."""
        lines = text.split(b"\n")
        return text if any(map(self.edged, lines)) else b" \n".join(lines)

    def apart(self, group: list[bytes]) -> None:
        """Puts chunks into the memo that begin with the newline they hold; encoded as one text they part at its id."""
        ids = self.ids([b"".join(group).decode()])[0]
        at = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.newline).tolist()
        if len(at) == len(group):
            self.update(zip(group, [ids[4 * x : 4 * y] for x, y in zip(at, [*at[1:], len(ids) // 4], strict=True)], strict=True))
        else:
            self.update(zip(group, self.ids([c.decode() for c in group]), strict=True))

    def learn(self, new: Collection[bytes]) -> None:
        breaks = [c for c in new if c[:1] == b"\n"]
        plain = [c for c in breaks if c.count(b"\n") == 1 and not self.edged(c[1:])]
        for at in range(0, len(plain), JOINED):
            self.apart(plain[at : at + JOINED])
        odd = list({*breaks}.difference(plain))
        self.update(zip(odd, self.ids([c.decode() for c in odd]), strict=True))
        rest = [c for c in new if c[:1] != b"\n"] if breaks else new
        stems = {c: stem for c in rest if c.endswith(self.ENDS) and (stem := c.rstrip(self.MARKS))[-1:].isalpha()}
        words = [c for c in rest if c not in stems] if stems else list(rest)
        words += {w for w in stems.values() if w not in self}.difference(words)
        super().learn(words)
        for c, stem in stems.items():
            mark = c[len(stem) :]
            if mark not in self.tails:
                if len(self.tails) > MEMO_WORDS:
                    self.tails.clear()
                self.tails[mark] = self.ids([mark.decode()])[0]
            self[c] = self[stem] + self.tails[mark]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The texts' ids. Arrow numbers the different chunks of all the texts, so that each of them is looked up once."""
        if len(self) > self.most:
            self.clear()
        whole = [self.whole(t) for t in texts]
        parts = pc.split_pattern(pa.array([b"" if w else self.spaced(t) for t, w in zip(texts, whole, strict=True)], pa.binary()), b" ")
        at = parts.offsets.to_numpy()
        first = parts.values.take(pa.array(at[:-1])).to_pylist()
        numbered = parts.values.dictionary_encode()
        chunks = cut(numbered.dictionary)
        found = list(map(self.get, chunks))
        lacking = [i for i, x in enumerate(found) if x is None]
        self.learn([chunks[i] for i in lacking])
        for i in lacking:
            found[i] = self[chunks[i]]
        found += self.ids([(t if w else f).decode() for t, w, f in zip(texts, whole, first, strict=True)])
        place = numbered.indices.to_numpy().astype(np.int64)
        place[at[:-1]] = np.arange(len(chunks), len(found))  # no space stands before a text's first chunk
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, own = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(begins[place] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = 4 * np.append(0, ends)[at]
        return [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(kind: type[Encoder], path: str) -> Encoder:
    """One for each Python worker, which keeps its memo from task to task."""
    return kind(path)
