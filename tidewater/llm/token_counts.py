"""Token counts by a count-only Viterbi search (operator 1).

Unigram segmentation without the pieces: an Aho-Corasick automaton enumerates
the vocabulary's matches as it reads the text, and dynamic programming carries
only the best score and its number of pieces to each place.

The rules are those of the unigram model of the public ``tokenizers`` library,
whose ids they must agree with: a place keeps the first of equally good
predecessors, and these are tried from the longest match to the shortest; a
character that is no piece by itself also counts as unknown, at the lowest
score less 10; neighbouring unknowns melt into one, or, with byte fallback, an
unknown run of n bytes is n pieces where the vocabulary has all bytes.

Where the space mark is a piece and no piece has it after another character (
runs of marks excepted), each mark that follows another character starts a
segment of its own, and distinct segments are searched once for each worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import kept, released, small_batches

SPACE = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Segments whose counts a worker keeps.
KNOWN_SEGMENTS = 500_000
#: Code points of a segment that is kept.
KNOWN_LENGTH = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(model_file: str) -> list[tuple[str, float]]:
    """The (piece, score) list of a sentencepiece model, in id order."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size())]


class CountModel:
    """Counts pieces under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unk: str = "<unk>", byte_fallback: bool = True):
        import ahocorasick

        self.scores = {}
        for piece, score in pieces:
            self.scores.setdefault(piece, score)
        lowest = min(self.scores.values(), default=0.0)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.unk = unk
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.scores), default=1)
        self.splits = SPACE in self.scores and not any(SPACE in p.lstrip(SPACE) for p in self.scores if p.strip(SPACE))
        self.known: dict[str, int] = {}

    def search(self, text: str) -> int:
        """The number of pieces of the best segmentation; what is held is as long as the longest piece."""
        n, ring = len(text), self.longest + 1
        if not n:
            return 0
        best, count = [0.0] * ring, [0] * ring  # pieces, an open run of unknowns not yet counted
        run = [0] * ring  # bytes of the unknown run that ends here
        matches = self.automaton.iter(text)
        last, found = next(matches, (n, None))
        unknown, cost = self.unknown, self._run_cost
        for end in range(1, n + 1):
            top = at = None
            single = False
            # matches come from the longest to the shortest, as the automaton follows its suffix links
            while last < end:
                size, score = found
                single |= size == 1
                total = best[(end - size) % ring] + score
                if top is None or total > top:
                    top, at = total, (end - size) % ring
                last, found = next(matches, (n, None))
            now, before = end % ring, (end - 1) % ring
            if not single:
                total = best[before] + unknown
                if top is None or total > top:
                    top, at = total, -1
            if at == -1:
                count[now], run[now] = count[before], run[before] + len(text[end - 1].encode("utf-8"))
            else:
                count[now], run[now] = count[at] + cost(run[at]) + 1, 0
            best[now] = top
        return count[n % ring] + cost(run[n % ring])

    def _run_cost(self, size: int) -> int:
        return (size if self.bytes_known else 1) if size else 0

    def segments(self, text: str) -> list[str]:
        """The text, space-marked, cut where no piece can cross."""
        text = text.replace(" ", SPACE)
        if not self.splits:
            return [text] if text else []
        parts = text.split(SPACE)
        out, marks = [], 0
        for k, part in enumerate(parts):
            marks += k > 0
            if part:
                out.append(SPACE * marks + part)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def count(self, text: str | None) -> int:
        total, known = 0, self.known
        for s in self.segments(text or ""):
            n = known.get(s)
            if n is None:
                n = self.search(s)
                if len(s) <= KNOWN_LENGTH and len(known) < KNOWN_SEGMENTS:
                    known[s] = n
            total += n
        return total


def _model(model_file: str) -> CountModel:
    """The model; the last one stays in the Python worker."""
    return kept(("token counts", model_file), lambda: CountModel(read_pieces(model_file)))


def token_counts(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; no shuffle.

    Spaces become marks and nothing is put before the text.
    Null and empty texts have none; repeated rows are counted each; other
    columns are left out. A worker keeps the counts of short segments, up to a
    fixed number; long texts are searched segment by segment.
    """
    small_batches(documents.sparkSession)
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
