"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, with memoised pieces.

A text is cut at single blanks and newlines, where its pre-tokenizer cuts it anyway: a blank between two runs without
blanks always starts a new token, a newline is one. (Texts where they meet other white space or an end are cut by
``PIECE`` instead, around any white space.) The distinct pieces of a stretch of texts are found by Arrow, and each is
encoded by the library once per worker, as far as the memory of pieces reaches. Pieces of letters and punctuation
(``WORD``) are cut and mapped to byte characters here, many at a time, and only merged by the library.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the pre-tokenizer's \\s; Python's own \\s differs on some control characters.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Pieces that a worker remembers unless told otherwise (half of them the most recently learned; about 200 bytes each),
#: and the longest that it remembers. More of them save time and cost memory; the ids are the same.
MEMO, MEMO_CHARS = 250_000, 64
#: Pieces in one call of the library: small runs stay in the processor's caches.
RUN = 64
#: Characters of the texts whose pieces are looked up together; a longer text is alone.
STRETCH = 1 << 23
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: Pieces that the pre-tokenizer cuts between letters and punctuation only, a newline before them apart.
WORD = re.compile(f"\n?[A-Za-zÀ-ÖØ-öø-ɏ]+[{_PUNCTUATION}]*").fullmatch
_BETWEEN = re.compile(f"([{_PUNCTUATION}]+)")
#: Newlines that the pre-tokenizer may join with their neighbours (blanks apart, which leave an empty piece).
JOINED = re.compile(f"\n(?:(?<=[{_WS}]\n)|(?=[{_WS}]))").search
#: Pieces without white space but a newline before them.
PLAIN = re.compile(f"\n?[^{_WS}]+").fullmatch
#: The pre-tokenizer whose cuts these are, and its pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary, but for the newline, which separates words."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)} | {10: "\n"}


_BYTES = _byte_characters()


class Memo:
    """Two generations of remembered pieces: what is used in the younger one survives, the older one is dropped."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most // 2

    def recall(self, pieces: list[str]) -> list[bytes | None]:
        """What is remembered of distinct pieces; those of the older generation become young."""
        if len(self.young) > self._most:
            self._old, self.young = self.young, {}
        got = list(map(self.young.get, pieces))
        if self._old:
            for k, p in enumerate(pieces):
                if got[k] is None and (known := self._old.get(p)) is not None:
                    got[k] = self.young[p] = known
        return got


class PieceEncoder:
    """``batch(texts)``: the ids of each text as uint32. Subclasses encode the pieces that are not remembered."""

    def __init__(self, remembered: int):
        #: By piece, and by piece without the blank before it.
        self._raw, self._after = Memo(remembered // 10), Memo(remembered - remembered // 10)

    def _encoded(self, pieces: list[str], lead: str) -> Iterator[tuple[str, bytes]]:
        """Ids of each of distinct pieces, after ``lead`` if it does not begin with a newline."""
        raise NotImplementedError

    def _ids(self, memo: Memo, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of distinct pieces, remembered or encoded now."""
        got = memo.recall(pieces)
        where = [k for k, x in enumerate(got) if x is None]
        if where:
            missing = [pieces[k] for k in where]
            new = dict(self._encoded(missing, lead))
            for k, p in zip(where, missing, strict=True):
                got[k] = new[p]
            memo.young.update(new)
            for p in missing:
                if len(p) > MEMO_CHARS:
                    del memo.young[p]
        return got

    def _after_blanks(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are pieces separated by single blanks, with a blank before each."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        pieces = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        ids = self._ids(self._after, pieces, " ")
        size = np.array(list(map(len, ids))) // 4
        data = np.frombuffer(b"".join(ids), "<u4")
        piece = coded.indices.to_numpy()
        n = size[piece]
        ends = np.append(0, np.cumsum(n))
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[piece] - ends[:-1], n)
        return np.split(data[at], ends[parts.offsets.to_numpy()[1:-1]])

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: empty)."""
        heads: list[list[str]] = []
        tails: dict[int, str] = {}
        for k, text in enumerate(texts):
            cut = (text or "").replace("\n", " \n")
            head, _, tail = cut.partition(" ")
            if not head or not tail or tail[0] == " " or tail[-1] == " " or "  " in tail or JOINED(text):
                heads.append(PIECE.findall(text or ""))
            else:
                heads.append([head])
                tails[k] = tail
        distinct = list(set(chain.from_iterable(heads)))
        known = dict(zip(distinct, self._ids(self._raw, distinct, ""), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, h)), "<u4") for h in heads]
        some, size = [], 0
        for k, tail in tails.items():
            some.append(k)
            size += len(tail)
            if size >= STRETCH or k == next(reversed(tails)):
                for i, ids in zip(some, self._after_blanks([tails[i] for i in some]), strict=True):
                    out[i] = np.concatenate([out[i], ids])
                some, size = [], 0
        return out


class Encoder(PieceEncoder):
    """The ids of ``tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, tokenizer_json: bytes, remembered: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__(remembered)
        self._tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._words = None
        spec = json.loads(tokenizer_json)
        if not spec.get("normalizer") and PRE_TOKENIZER.items() <= (spec.get("pre_tokenizer") or {}).items():
            spec |= {"added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "post_processor": None}
            self._words = Tokenizer.from_str(json.dumps(spec))
            vocabulary = self._words.get_vocab()
            #: Bytes of each token.
            self._size = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self._size[list(vocabulary.values())] = list(map(len, vocabulary))
        self._newline = array("I", self._tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()

    def _merged(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of ``WORD`` pieces without newlines, each after ``lead``."""
        if not words:
            return []
        ids: list[int] = []
        for at in range(0, len(words), RUN):
            lines = _BETWEEN.sub(r"\n\1", lead + ("\n" + lead).join(words[at : at + RUN]))
            (e,) = self._words.encode_batch_fast([lines.encode().decode("latin-1").translate(_BYTES)], add_special_tokens=False)
            ids += e.ids
        data = np.array(ids, "<u4")
        # A word ends with a token, so that the bytes up to there tell how many tokens it has.
        ends = np.flatnonzero(np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8) == 10)
        ends += np.arange(len(words)) * (len(lead) - 1) + len(lead)
        cuts = (4 * np.searchsorted(np.cumsum(self._size[data]), ends) + 4).tolist()
        data = data.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _encoded(self, pieces: list[str], lead: str) -> Iterator[tuple[str, bytes]]:
        words = list(filter(WORD, pieces)) if self._words else []
        yield from zip(plain := [p for p in words if p[0] != "\n"], self._merged(plain, lead), strict=True)
        yield from zip(lines := [p for p in words if p[0] == "\n"], [self._newline + x for x in self._merged([p[1:] for p in lines], "")], strict=True)
        odd = list(set(pieces).difference(words))
        for at in range(0, len(odd), RUN):
            some = odd[at : at + RUN]
            got = self._tokenizer.encode_batch_fast([p if p[0] == "\n" else lead + p for p in some], add_special_tokens=False)
            yield from zip(some, [array("I", e.ids).tobytes() for e in got], strict=True)


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(sent, remembered: int = MEMO) -> Encoder:
    """This worker's encoder of the broadcast tokenizer file."""
    data = sent.value
    key = hash(data), remembered
    if key not in _encoders:
        _encoders.clear()
        gc.disable()  # the worker's many strings hold no cycles, and each full collection would walk their tables
        _encoders[key] = Encoder(data, remembered)
    return _encoders[key]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
