"""Text generators. The default needs no model: it quotes the best passage of the prompt."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import functions as F

#: The notice that every answer ends with.
NOTICE = "What you read here informs about the law and is not legal advice; only a lawyer who knows your case can give that."
#: What the model is told before every prompt.
SYSTEM = f"""You explain Indian law to people without legal training.
What you say about the law comes from the passages of the prompt and from nowhere else, and names the passage it comes from. Explain every technical word. Where the passages don't settle a question, tell the reader so. Where someone is in danger or under threat of arrest, first send them to the police or a lawyer. Give information, never an opinion on the outcome, and end with: {NOTICE}"""
#: What stands before a quoted passage and what is said where there is none.
QUOTED, NOTHING = "The closest passage of the knowledge base reads:", "The knowledge base holds nothing that answers this question."

#: A generator: prompts, what the model is told, tokens at most, temperature -> answers.
Generate = Callable[[list[str], str, int, float], list[str]]

_FIRST = re.compile(r"--- Passage 1 ---\n[^\n]*\n([\s\S]{0,300})")


def extractive() -> Generate:
    """A stand-in for a model: the first 300 characters after the head of the first passage, and the notice."""

    def answer(prompts: list[str], system: str, max_tokens: int, temperature: float) -> list[str]:
        return [f"{QUOTED} {m[1]}\n\n{NOTICE}" if (m := _FIRST.search(p)) else f"{NOTHING}\n\n{NOTICE}" for p in prompts]

    return answer


def generator(load: Callable[[], Generate] = extractive, system: str = SYSTEM, max_tokens: int = 1024, temperature: float = 0.1, batch: int = 32):
    """A pandas UDF from prompts to answers; ``load`` is called once per task and returns the generator.

    Answers are stripped; a null prompt gives null and is not sent.
    """

    @F.pandas_udf("string")
    def answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = load()
        for part in prompts:
            out: list[str | None] = [None] * len(part)
            at = [i for i, p in enumerate(part) if p is not None]
            for lo in range(0, len(at), batch):
                some = at[lo : lo + batch]
                for i, a in zip(some, ask([part.iloc[i] for i in some], system, max_tokens, temperature)):
                    out[i] = a.strip()
            yield pd.Series(out, dtype=object)

    return answer
