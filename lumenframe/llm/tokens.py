"""Byte-level BPE encoding with a cache of whitespace-delimited pieces."""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable, Iterable, Iterator

from .common import only, worker_cache

#: Pieces kept by a Python worker; about 250 bytes each. Later pieces have places for RECENT_PIECES, emptied when all are taken.
CACHE_PIECES = 400_000
RECENT_PIECES = 40_000

#: Characters of the texts that encode_many cuts at once.
BATCH_CHARS = 8 << 20

#: Latin letters only; for these Python and the tokenizer surely agree on what a letter is.
_LAST_LATIN = "\u024f"
#: The visible character of each byte in byte-level vocabularies: itself where printable, else the next from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_VISIBLE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}

#: ASCII marks without the apostrophe, with which a word of its own may begin. The tokenizer cuts between letters and such marks.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

#: White space other than space and newline, and the character that marks cuts.
_ODD = re.compile(r"[^\S \n]")
_ODD_ASCII = [c for c in map(chr, range(128)) if _ODD.match(c)] + ["\x00"]
_encoders: dict[tuple[str, bool], "PieceEncoder"] = worker_cache("tokens")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache(dict):
    """Ids of pieces; a missing one is encoded as it is looked up, so that a text takes one pass over its pieces."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.encode, self.recent = encode, {}

    def __missing__(self, piece: str) -> bytes:
        recent = self.recent
        found = recent.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(self) < CACHE_PIECES:
                self[piece] = found
            else:
                if len(recent) >= RECENT_PIECES:
                    recent.clear()
                recent[piece] = found
        return found


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A byte-level BPE tokenizer cuts a text into words first, each with the space before it, and a merge
    never crosses a cut. Where no two whitespace characters are neighbours and the only ones are space and
    newline, cutting before each space and around each newline cuts only where the tokenizer cuts itself, so
    the ids of a text are those of its pieces, and a piece is encoded once while the worker keeps it. Other texts go to the
    tokenizer whole; so do texts that hold the string of an added token, which has an id of its own, as in the
    library's plain call. With specials_as_text such strings are ordinary text instead, so that no document can write
    a control token.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.marks: dict[str, bytes] = {"": b""}
        self.cache = PieceCache(self._piece)

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece. Latin letters are one word, and marks after them another: the word goes to the library's merging without its cutting."""
        stem = piece.rstrip(_MARKS)
        core = stem[1:] if stem[:1] == " " else stem
        if not (core.isalpha() and (core.isascii() or max(core) <= _LAST_LATIN)):
            return self._whole(piece)
        run = piece[len(stem) :]
        if run not in self.marks:
            if len(run) > 4 or len(self.marks) > 1000:
                return self._whole(piece)
            self.marks[run] = self._whole(run)
        if run and stem in self.cache:
            return self.cache[stem] + self.marks[run]
        shown = stem.replace(" ", _VISIBLE[32]) if stem.isascii() else stem.encode().decode("latin-1").translate(_VISIBLE)
        return array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes() + self.marks[run]

    def _cut(self, text: str) -> str | None:
        """The text with cuts marked, or None where it has to be encoded whole."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _ODD_ASCII):
            return None
        if not text.isascii() and _ODD.search(text):
            return None
        if self.added and self.added.search(text):
            return None
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        cut = self._cut(text)
        return self._whole(text) if cut is None else b"".join(map(self.cache.__getitem__, cut.split("\x00")))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode of each text in turn; a piece is looked up once for some BATCH_CHARS of text."""
        held, size = [], 0
        for text in texts:
            n = len(text or "")
            if held and size + n > BATCH_CHARS:
                yield from self._batch(held)
                held, size = [], 0
            held.append(text)
            size += n
        yield from self._batch(held)

    def _batch(self, texts: list[str | None]) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(texts) < 2:  # so a single text may be of any size, and those below stay within 32-bit offsets
            yield from map(self.encode, texts)
            return
        cuts = [self._cut(t) if t else None for t in texts]
        pieces = pc.split_pattern(pa.array([c for c in cuts if c is not None], pa.string()), "\x00")
        coded = pieces.values.dictionary_encode()
        ids = pa.array(list(map(self.cache.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))), pa.binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        at = iter(np.frombuffer(ends, "<i4")[pieces.offsets.to_numpy()].tolist() if len(ids) else [0])
        begin, data = next(at), memoryview(data or b"")
        for text, cut in zip(texts, cuts):
            if cut is None:
                yield self._whole(text) if text else b""
            else:
                end = next(at)
                yield data[begin:end].tobytes()
                begin = end


def encoder(path: str, specials_as_text: bool = False) -> PieceEncoder:
    """The worker's encoder for that vocabulary file."""
    only("tokens")
    if (path, specials_as_text) not in _encoders:
        _encoders[path, specials_as_text] = PieceEncoder(path, specials_as_text)
    return _encoders[path, specials_as_text]
