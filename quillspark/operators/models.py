"""Model calls as injected callables: providers in order, retries, extraction with fallbacks."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillspark.functions import text as T
from quillspark.operators.enrich import with_retry

# Answers that may pass, words that tell of a spent quota.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
QUOTA_CODES, QUOTA_WORDS = (402, 403), ("quota", "credit", "billing", "insufficient")
LEAST_TEXT = 200

Provider = Callable[[str], str]


class CreditExhausted(RuntimeError):
    """A provider's quota is spent; no other call will succeed."""


class CallFailed(RuntimeError):
    def __init__(self, code: int, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def order(primary: str, fallbacks: str, known: tuple[str, ...]) -> list[str]:
    """Provider names, the primary first, each once; an unknown name raises ValueError."""
    names = list(dict.fromkeys(n.strip().lower() for n in [primary, *fallbacks.split(",")] if n.strip()))
    for n in names:
        if n not in known:
            raise ValueError(f"unknown provider {n}: one of {', '.join(known)}")
    return names


def settings(text: str, environment: Mapping[str, str] = os.environ) -> dict[str, str]:
    """``KEY=VALUE`` lines under an environment that takes precedence."""
    own = {}
    for line in text.splitlines():
        key, found, value = line.strip().partition("=")
        if found and key and not key.startswith("#"):
            own[key.strip()] = value.strip().strip("\"'")
    return {**own, **{k: environment[k] for k in own if k in environment}}


def router(providers: dict[str, Provider], names: list[str], sleep: Callable[[float], None], tries: int = 4) -> Provider:
    """Asks providers in order until one answers; a spent quota ends the search."""

    def one(name: str, prompt: str) -> str:
        def call() -> str:
            try:
                return providers[name](prompt)
            except CallFailed as e:
                if e.code in QUOTA_CODES and any(w in e.message.lower() for w in QUOTA_WORDS):
                    raise CreditExhausted(f"{name}: {e.message}") from e
                raise

        return with_retry(call, lambda e: isinstance(e, CallFailed) and e.code in RETRYABLE, sleep, tries, 30.0)

    def ask(prompt: str) -> str:
        failed = []
        for name in names:
            if name not in providers:
                continue
            try:
                return one(name, prompt)
            except CreditExhausted:
                raise
            except Exception as e:
                failed.append(f"{name}: {e}")
        raise RuntimeError("no provider answered: " + "; ".join(failed))

    return ask


def replies(ask: Provider) -> Callable[[Column], Column]:
    """A column function from prompts to ``reply, error``; one call for each prompt of a batch."""

    @F.arrow_udf(StructType().add("reply", StringType()).add("error", StringType()))
    def run(prompts: pa.Array) -> pa.Array:
        known: dict[str, tuple[str | None, str | None]] = {}
        out = []
        for p in prompts.to_pylist():
            if p is not None and p not in known:
                try:
                    known[p] = ask(p), None
                except CreditExhausted:
                    raise
                except Exception as e:
                    known[p] = None, str(e)
            reply, error = known.get(p, (None, None))
            out.append({"reply": reply, "error": error})
        return pa.array(out, pa.struct([("reply", pa.string()), ("error", pa.string())]))

    return run


def extraction_input(papers: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """Adds ``extraction_source, extraction_text``: the PDF's text if there is enough of it, else
    the abstract, else the title alone."""
    text, abstract = T._text("pdf_text"), T._text("abstract")
    long, told = F.length(F.trim(text)) > least, F.trim(abstract) != ""
    return papers.withColumns(
        {
            "extraction_source": F.when(long, "pdf_text_fallback").when(told, "abstract").otherwise("title_only"),
            "extraction_text": F.when(long, text).when(told, abstract).otherwise(T._text("title")),
        }
    )
