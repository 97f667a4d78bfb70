"""Prompt text with the character anchors that the token positions hang on."""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.text import is_blank
from crossblock.functions.values import insist

# The prompt wording.
SYSTEM = (
    "Answer factual questions in exactly this format, and nothing else:\n"
    "Answer: <the answer entity only -- no sentence, no punctuation, no explanation>\n"
    "Confidence: <high or low>\n"
    "Never restate the question. Never write a full sentence."
)
INSTRUCTION = (
    "Answer each question with the answer entity only -- no sentence, no explanation. "
    "Then state your confidence in the answer as either high or low."
)


@dataclass(frozen=True)
class PromptText:
    system: str = SYSTEM
    instruction: str = INSTRUCTION
    question_prefix: str = "Question:"
    answer_prefix: str = "Answer:"
    confidence_prefix: str = "Confidence:"
    separator: str = " "
    newline: str = "\n"

    @property
    def template_hash(self) -> str:
        return hashlib.sha256("\x1f".join(astuple(self)).encode()).hexdigest()[:16]

    def raw_prefix(self, question: Column) -> Column:
        """Everything before the answer prefix, for models without a chat template."""
        opening = f"{self.instruction}{self.newline}{self.newline}{self.question_prefix}"
        return F.concat(F.lit(opening + self.separator), question, F.lit(self.newline))


def render_prompts(
    df: DataFrame,
    *,
    question: str = "question",
    answer: str = "answer",
    prefix: str | None = None,
    text: PromptText = PromptText(),
) -> DataFrame:
    """Add prompt, anchors, prompt_sha256 and template_hash.

    `prefix` names a column with the caller's own text before the answer prefix (a chat
    template); without it the raw style is used. Blank questions or answers fail the job.
    """
    q, a = F.col(question), F.col(answer)
    df = insist(df, ~is_blank(q) & ~is_blank(a), "a question or an answer is blank")
    head = F.col(prefix) if prefix else text.raw_prefix(q)
    tail = f"{text.newline}{text.confidence_prefix}"
    prompt = F.concat(head, F.lit(text.answer_prefix + text.separator), a, F.lit(tail))
    boundary = F.char_length(head) + F.lit(len(text.answer_prefix))
    start = boundary + F.lit(len(text.separator))
    end = start + F.char_length(a)
    anchors = F.struct(
        (boundary - 1).alias("answer_colon"),
        boundary.alias("answer_boundary"),
        start.alias("answer_start"),
        end.alias("answer_end"),
        end.alias("newline"),
        (end + F.lit(len(tail) - 1)).alias("confidence_colon"),
    )
    return df.withColumns({"prompt": prompt, "anchors": anchors}).withColumns(
        {
            "prompt_sha256": F.sha2("prompt", 256),
            "template_hash": F.lit(text.template_hash),
        }
    )
