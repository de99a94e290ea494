"""Token counts of a unigram tokenizer: Aho-Corasick matches, count-only Viterbi.

The pieces and their scores come from a vocabulary file of a public tokenizer; nothing is trained.
A text is cut as the ``tokenizers`` library's Unigram model with a Metaspace pre-tokenizer cuts it:
blanks become U+2581 and start a word each, the first word gets one if it has none. Within a word the
automaton enumerates all vocabulary matches by their end; for each end the best score and the number of
pieces of the best path are carried, nothing else, and no further back than the longest piece reaches.

Tie rules of that library: a later candidate must be strictly better, candidates for an end come by
ascending start (longest first); a character that is no piece itself may be unknown at the least
score minus 10, as the last candidate; neighbouring unknowns fuse, and are counted as their UTF-8
bytes if the vocabulary has all byte pieces, as one piece otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_arrow, slices

MARK = "▁"
#: Words whose counts a worker remembers; the table is emptied when full.
CACHE = 400_000
#: Code points of a text that are cut into words at a time, up to the next blank.
STRETCH = 1 << 18
_BREAK = re.compile(f"[ {MARK}]")


def load_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the unknown piece's id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    """Counts pieces of the best segmentation of single words and whole texts."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int) -> None:
        import ahocorasick

        self.scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                self.scores[piece] = score
        self.unknown = min(s for _, s in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.bytes_fall_back = all(f"<0x{b:02X}>" in names for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.scores))
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over one word. Unknown runs are counted as they close.

        The three tables are rings as long as the longest piece, so a word of any length takes the same memory.
        """
        ring = self.longest + 1
        best = [0.0] * ring
        count = [0] * ring  # closed pieces, without an unknown run that is still open
        run = [0] * ring  # cost of the open unknown run
        matches = self.automaton.iter(word)
        end, value = next(matches, (-1, None))
        for e in range(1, len(word) + 1):
            top = chosen = None
            length = 0
            while end == e - 1:
                length, score = value
                s = best[(e - length) % ring] + score
                if top is None or s > top:
                    top, chosen = s, length
                end, value = next(matches, (-1, None))
            to, before = e % ring, (e - 1) % ring
            if length != 1 and (top is None or best[before] + self.unknown > top):  # the shortest match comes last
                best[to], count[to] = best[before] + self.unknown, count[before]
                run[to] = run[before] + len(word[e - 1].encode("utf-8", "surrogatepass")) if self.bytes_fall_back else 1
            else:
                at = (e - chosen) % ring
                best[to], count[to], run[to] = top, count[at] + run[at] + 1, 0
        at = len(word) % ring
        return count[at] + run[at]

    def words(self, text: str) -> Iterator[str]:
        """The words of a text, without their marks; memory follows STRETCH and the longest word."""
        at, n = 0, len(text)
        while at < n:
            cut = _BREAK.search(text, at + STRETCH)
            end = cut.start() if cut else n
            part = text[at:end].replace(" ", MARK)
            found = part.split(MARK)
            yield from found[1:] if part[0] == MARK else found
            at = end

    def text(self, text: str) -> int:
        """Pieces of a whole text; the empty text has none."""
        total, seen = 0, self.seen
        for w in self.words(text):
            n = seen.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(w) <= 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[w] = n
            total += n
        return total


@lru_cache(2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(*load_pieces(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_chars and n_bytes (longs) of every row; null text counts as empty.

    Repeated rows and null ids are kept, an empty table gives no rows. A worker holds the texts of about
    16 MB of rows, or one longer text, and a few megabytes of tables, however long a text or a word is.

    :param path: a vocabulary file that every executor has at that place.
    """

    def run(batches):
        import pyarrow.compute as pc

        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = pc.fill_null(part.column(1), "")
                counts = [counter.text(t.as_py()) for t in texts]
                yield {"doc_id": part.column(0), "n_tokens": counts, "n_chars": pc.utf8_length(texts).cast("int64"), "n_bytes": pc.binary_length(texts).cast("int64")}

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_tokens long, n_chars long, n_bytes long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of all whole documents, with the public 32k pieces and their scores."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
