"""Token counts under a unigram vocabulary without building the tokens.

An Aho-Corasick automaton finds all vocabulary pieces in a word; dynamic programming carries, for each place, the best
score and the number of pieces of the best way there.  Ties follow the tokenizers library: of equally good ways to a
place, the one whose last piece begins first.  A character that no piece covers alone counts as its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from quernlog.llm.arrow import map_texts

#: Words whose counts a task keeps; the store is emptied when it is full.
KEPT = 400_000
#: What an unknown character costs beyond the worst piece.
UNKNOWN_COST = 10.0
BLANK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(1)
def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id; control pieces never stand in a text and are empty."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    unseen = {i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i)}
    return [("" if i in unseen else model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Best score and piece count of words."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_COST
        self.kept: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and best score of a word with its leading blank mark."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)

        def unknown(place: int, filled: bool) -> None:
            value = best[place - 1] + self.unknown
            if not filled or value > best[place]:
                best[place] = value
                count[place] = count[place - 1] + len(word[place - 1].encode("utf-8", "replace"))

        now, filled, single = 0, True, True  # the place whose ways are compared; whether it has one, and a one-character piece
        for last, (length, score) in self.automaton.iter(word):  # by place, the longest piece first
            if last + 1 != now:
                if not single:
                    unknown(now, filled)
                for place in range(now + 1, last + 1):
                    unknown(place, False)
                now, filled, single = last + 1, False, False
            value = best[now - length] + score
            if not filled or value > best[now]:
                best[now], count[now], filled = value, count[now - length] + 1, True
            single = single or length == 1
        if not single:
            unknown(now, filled)
        for place in range(now + 1, n + 1):
            unknown(place, False)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and best score of a text: every blank begins a word, and so does the text."""
        parts = text.replace(BLANK, " ").split(" ")
        if not parts[0]:
            parts = parts[1:]
        total, score = 0, 0.0
        kept = self.kept
        for part in parts:
            found = kept.get(part)
            if found is None:
                if len(kept) >= KEPT:
                    kept.clear()
                found = kept[part] = self.word(BLANK + part)
            total += found[0]
            score += found[1]
        return total, score


@lru_cache(1)
def _counter(path: str) -> Counter:
    return Counter(pieces(path))


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document doc_id, n_tokens and score, the sum of the scores of its pieces.

    Null and empty texts have no token.  Texts are read whole; repeated rows get equal results; an empty table gives
    none; other columns are left out.  ``vocabulary`` is a path that all executors have.
    """
    path = vocabulary or default_vocabulary()

    def start() -> Callable[[list[str]], dict[str, list]]:
        counter = _counter(path)

        def run(texts: list[str]) -> dict[str, list]:
            found = [counter.text(t) for t in texts]
            return {"n_tokens": [f[0] for f in found], "score": [f[1] for f in found]}

        return run

    return map_texts(docs, ["doc_id"], "n_tokens long, score double", start)
