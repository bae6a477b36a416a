"""Messages: deflected work, and decisions handed to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import wordlists as L


def flat_assertion(text: Column) -> Column:
    """What a message asserts in its own voice, on one line and in lower case."""
    return F.lower(F.btrim(F.regexp_replace(S.asserted_text(text), r"\s+", " ")))


def phrases_of(text: Column, phrases: list[str]) -> Column:
    """array<struct<phrase, pos>>: the earliest place (from one) of each phrase in what a message asserts; texts without any are not read on."""
    def places(flat: Column) -> Column:
        return F.array_compact(F.array(*(F.when(F.contains(flat, F.lit(p)), F.struct(F.lit(p).alias("phrase"), F.instr(flat, p).alias("pos"))) for p in phrases)))

    return S.let(flat_assertion(text), places)


def phrase_hits(messages: DataFrame, phrases: list[str], key: str = "msg_id") -> DataFrame:
    """key, phrase, pos of phrases_of."""
    return messages.select(key, F.explode(phrases_of(F.col("text"), phrases)).alias("h")).select(key, "h.phrase", "h.pos")


def deferrals(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """Deferral phrases, each once."""
    return phrase_hits(messages, L.DEFERRALS, key)


CUES = ["should", "shall", "want", "would", "do", "could", "may", "can", "which", "ok", "okay"]


def questions_of(text: Column, cues: list[str] | None = None) -> Column:
    """array<struct<line_no, line>> of lines that hand a question to the reader: one at a line's end, or one with a cue in its first two words."""
    cue = "|".join(cues or CUES)
    asks = lambda x: F.contains(x, F.lit("?")) & (x.rlike(r"\?[\s)\"'*_`]*$") | x.rlike(rf"(?i)(^|[.!?]\s+)([A-Za-z']+\s+)?(?:{cue})(?![A-Za-z])[^.!?]*\?\s"))
    numbered = F.transform(S.lines_of(S.asserted_text(text)), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    return F.when(F.contains(text, F.lit("?")), F.filter(numbered, lambda q: asks(q["line"]))).otherwise(F.array().cast("array<struct<line_no: int, line: string>>"))


def questions(messages: DataFrame, cues: list[str] | None = None, key: str = "msg_id") -> DataFrame:
    """key, line_no, line of questions_of."""
    return messages.select(key, F.explode(questions_of(F.col("text"), cues)).alias("q")).select(key, "q.line_no", "q.line")
