"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last code points has a fixed residue, so equal passages are cut alike in every
document.  A chunk is encoded when a task meets it first and its ids are used for all later documents of that task.
Cutting changes the ids near a joint; there the two sides are decoded back to text and encoded anew between the nearest
places at which the tokenizer splits in any context, so the ids agree with those of the whole text.

There is no shuffle: the ids of a text take more room than the text, so moving them would cost more than encoding.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlog.llm.arrow import map_texts
from quernlog.llm.textarrays import code_points, prefix_sums, span_hashes

WINDOW = 24
#: One place in so many is a cut; chunks have this mean length in code points, no most length.
MEAN_CHUNK = 1024
LEAST_CHUNK = 256
#: Code points of chunks that a task keeps for reuse; the least recently used go first.
KEPT = 4_000_000
#: Text made of these characters is split alike by both libraries; other text goes to the reference one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*\Z")
#: A letter or punctuation mark, then a blank before a letter: the tokenizer splits before the blank in any context.
_SPLIT = re.compile(r"(?<=[!-~À-ÖØ-öø-ſ])(?= [A-Za-zÀ-ÖØ-öø-ſ])")


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    if len(text) <= LEAST_CHUNK:
        return [len(text)] if text else []
    sums = prefix_sums(code_points(text))
    ends = np.arange(max(WINDOW, LEAST_CHUNK), len(text) + 1)
    places = ends[span_hashes(sums, ends - WINDOW, ends) % np.uint64(MEAN_CHUNK) == 0].tolist()
    out, last = [], 0
    for p in places:
        if p - last >= LEAST_CHUNK:
            out.append(p)
            last = p
    if last < len(text):
        out.append(len(text))
    return out


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.no_truncation()
        self.whole.no_padding()
        size = self.whole.get_vocab_size()
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        tokens = [self.whole.id_to_token(i) for i in range(size)]
        self.bytes = [t.encode() if t in special else bytes(to_byte[c] for c in t) for t in tokens]
        self.names = [str(i) for i in range(size)]
        self.special = special
        self.fast = Encoding(
            "vocabulary", pat_str=_pattern(), mergeable_ranks={b: i for i, b in enumerate(self.bytes) if tokens[i] not in special},
            special_tokens=special,
        )
        self.chunks: OrderedDict[str, array] = OrderedDict()  # four bytes an id
        self.kept = 0

    def encode_span(self, text: str) -> list[int]:
        if _PLAIN.match(text):
            return self.fast.encode(text, allowed_special="all")
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode_chunk(self, text: str) -> list[int]:
        found = self.chunks.get(text)
        if found is not None:
            self.chunks.move_to_end(text)
            return found.tolist()
        found = self.encode_span(text)
        self.chunks[text] = array("I", found)
        self.kept += len(text)
        while self.kept > KEPT and len(self.chunks) > 1:
            self.kept -= len(self.chunks.popitem(last=False)[0])
        return found

    def decode(self, ids: list[int]) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """Ids of a text, chunk by chunk."""
        out: list[int] = []
        open_text = ""  # text since the last sure split, not yet encoded for good
        start = 0
        for end in cuts(text):
            chunk = text[start:end]
            start = end
            first, last = self._splits(chunk)
            if first is None:  # no sure split inside: the joint's text grows by the whole chunk
                open_text += chunk
                continue
            ids = self.encode_chunk(chunk)
            head = self._ids_of_prefix(ids, len(chunk[:first].encode())) if open_text else 0
            tail = self._ids_of_suffix(ids, len(chunk[last:].encode()))
            if head is None or tail is None or (open_text and head > len(ids) - tail):
                open_text += chunk
                continue
            if open_text:
                out += self.encode_span(open_text + chunk[:first])
                out += ids[head : len(ids) - tail]
            else:
                out += ids[: len(ids) - tail]
            open_text = chunk[last:]
        if open_text:
            out += self.encode_span(open_text)
        return out

    def _splits(self, chunk: str) -> tuple[int | None, int]:
        """First and last sure split of a chunk; none of them inside or next to a special token."""
        first = _SPLIT.search(chunk)
        if first is None:
            return None, 0
        last, at = first.start(), len(chunk)
        while at > first.start():
            at = chunk.rfind(" ", 0, at)
            if at <= first.start():
                break
            if _SPLIT.match(chunk, at):
                last = at
                break
        return first.start(), last

    def _ids_of_prefix(self, ids: list[int], size: int) -> int | None:
        """Number of ids that make up the first ``size`` bytes; none if no token ends there."""
        n = 0
        while size > 0:
            size -= len(self.bytes[ids[n]])
            n += 1
        return n if size == 0 else None

    def _ids_of_suffix(self, ids: list[int], size: int) -> int | None:
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes[ids[-n]])
        return n if size == 0 else None


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _pattern() -> str:
    from public_tokenizers import PATTERN

    return PATTERN


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids, joined by commas) and decoded_sha256.

    Null texts count as empty: no token, and the digests of the empty string.  Repeated rows give repeated results; an
    empty table gives none; other columns are left out.  Special tokens written in a text are encoded as such.
    Memory is bounded by a text, an Arrow batch and the kept chunks.  ``vocabulary`` is a path that all executors have.
    """
    path = vocabulary or default_vocabulary()

    def start() -> Callable[[list[str]], dict[str, list]]:
        codec = _codec(path)

        def run(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = codec.encode(text)
                listed = ",".join(map(codec.names.__getitem__, ids))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            return out

        return run

    return map_texts(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def encoded(docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_tokens, the ids of each text, and whether decoding them gives the text again (``exact``).

    Null texts count as empty.
    """
    path = vocabulary or default_vocabulary()

    def start() -> Callable[[list[str]], dict[str, list]]:
        codec = _codec(path)

        def run(texts: list[str]) -> dict[str, list]:
            ids = [codec.encode(t) for t in texts]
            return {"n_tokens": [len(i) for i in ids], "ids": ids, "exact": [codec.decode(i) == t for i, t in zip(ids, texts)]}

        return run

    return map_texts(docs, list(keep), "n_tokens long, ids array<int>, exact boolean", start)


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The texts of encoded rows."""
    path = vocabulary or default_vocabulary()

    def start() -> Callable[[list[str]], dict[str, list]]:
        codec = _codec(path)
        return lambda lists: {"decoded": [codec.decode(list(map(int, x.split(",")))) if x else "" for x in lists]}

    listed = rows.select("doc_id", F.array_join("ids", ",").alias("text"))
    return map_texts(listed, ["doc_id"], "decoded string", start).withColumnRenamed("decoded", "text")
