"""Token counts of a unigram vocabulary by dynamic programming shared in a trie.

A document's tokens are those of its pre-tokens (white-space words with a leading mark).
Each task inserts the distinct pre-tokens that it meets in a trie.  A node holds the best
score of its prefix and the number of tokens on that path, computed once from the scores of
its ancestors when the node is made; a pre-token's count is stored at its terminal.  Nothing
is shuffled, and the trie starts anew when it reaches ``NODES`` nodes.  A pre-token of over
``LONG`` characters shares no prefix worth keeping: its forward scores are computed in slices.

Pieces and their order come from a public vocabulary; a piece at rank r scores the log
probability of Zipf's law, -ln((r + 1) * H).  A character that no piece covers costs as many
tokens as it has UTF-8 bytes, each at ten below the least score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

NODES, LONG, SLICE = 1_000_000, 10_000, 100_000
MARK = "▁"
UNKNOWN = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, float]:
    """Piece to score, by rank among the pieces that are ordinary text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1.0 / (r + 1) for r in range(len(plain)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(plain)}


class Trie:
    """Children by (node, character); best score and token count by node; counts by whole pre-token."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES) -> None:
        self.pieces, self.most = pieces, nodes
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of ``MARK + word``."""
        if len(word) >= min(LONG, self.most - 1):
            return self.forward(MARK + word)
        if len(self.score) + len(word) + 1 > self.most:
            self.reset()
        text, path, child = MARK + word, [0], self.child
        node = 0
        for end, c in enumerate(text, 1):
            below = child.get((node, c))
            if below is None:
                below = child[node, c] = len(self.score)
                self._extend(text, end, path, self.score, self.tokens)
            node = below
            path.append(node)
        self.terminal[word] = self.tokens[node]
        return self.tokens[node]

    def forward(self, text: str, size: int = SLICE) -> int:
        """Tokens of a text outside the trie; no more than ``size`` scores are held at once."""
        scores, tokens = [0.0], [0]
        for at in range(0, len(text), size):
            back = min(at, self.longest)
            part, scores, tokens = text[at - back : at + size], scores[-back - 1 :], tokens[-back - 1 :]
            for end in range(back + 1, len(part) + 1):
                self._extend(part, end, range(len(part)), scores, tokens)
        return tokens[-1]

    def _extend(self, text: str, end: int, path: Sequence[int], scores: list[float], tokens: list[int]) -> None:
        """Adds the scores of ``text[:end]``; of equal scores the path of fewer tokens, then of the longer last piece."""
        pieces = self.pieces
        best, count = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            own = pieces.get(text[start:end])
            if own is None:
                continue
            s, n = scores[path[start]] + own, tokens[path[start]] + 1
            if s > best or s == best and n < count:
                best, count = s, n
        if text[end - 1] not in pieces:
            width = len(text[end - 1].encode("utf-8", "surrogatepass"))
            s, n = scores[path[end - 1]] + width * self.unknown, tokens[path[end - 1]] + width
            if s > best or s == best and n < count:
                best, count = s, n
        scores.append(best)
        tokens.append(count)

    def count(self, words: list[str]) -> int:
        terminal, total = self.terminal, 0
        for word, n in Counter(words).items():
            known = terminal.get(word)
            total += n * (self.insert(word) if known is None else known)
        return total


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, n_pretokens, n_tokens``.

    Null and empty texts have none.  Repeated rows and null ids stay.  Texts and words of any
    length are counted whole, in bounded memory beside the text.  Ties of scores take fewer
    tokens.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(load_pieces(vocabulary))
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                own = (text or "").split()
                words.append(len(own))
                tokens.append(trie.count(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
