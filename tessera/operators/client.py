"""Clients of answer models, with retries and token counts, for use on executors."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "text string, input_tokens bigint, output_tokens bigint"
#: A reply: the text, and the tokens of prompt and reply where the provider tells them.
Reply = tuple[str, int | None, int | None]


def _ollama(model: str, temperature: float, most: int) -> Callable[[str], Reply]:
    def send(prompt: str) -> Reply:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
        asked = urllib.request.Request("http://localhost:11434/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=120) as r:
            return json.load(r)["response"], None, None

    return send


def _groq(model: str, temperature: float, most: int) -> Callable[[str], Reply]:
    from groq import Groq  # only where this provider is used

    chat = Groq().chat.completions

    def send(prompt: str) -> Reply:
        r = chat.create(model=model, messages=[{"role": "user", "content": prompt}], temperature=temperature, max_tokens=most)
        return r.choices[0].message.content, r.usage and r.usage.prompt_tokens, r.usage and r.usage.completion_tokens

    return send


def _gemini(model: str, temperature: float, most: int) -> Callable[[str], Reply]:
    from google import genai

    models = genai.Client().models
    return lambda prompt: (models.generate_content(model=model, contents=prompt).text, None, None)


PROVIDERS = {"ollama": _ollama, "groq": _groq, "gemini": _gemini}


def provider(name: str, model: str, temperature: float = 0.0, most: int = 1024) -> Callable[[], Callable[[str], Reply]]:
    """What makes a provider's sender in a worker; an unknown name is an error at once."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}; there are {', '.join(PROVIDERS)}")
    return lambda: PROVIDERS[name](model, temperature, most)


def retried(send: Callable[[str], Reply], attempts: int = 4, least: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Reply]:
    """send, tried again after errors with waits that double from ``least`` to ``most`` seconds; the last error is raised."""

    def ask(prompt: str) -> Reply:
        for k in range(attempts):
            try:
                return send(prompt)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(min(most, max(least, 2.0**k)))
        raise ValueError("no attempts")

    return ask


def complete(make: Callable[[], Callable[[str], Reply]], **retry):
    """A column function from prompt to a struct of text, input_tokens and output_tokens. make is called once in each worker, so connections are made there."""

    @F.pandas_udf(REPLY)
    def run(prompt: pd.Series) -> pd.DataFrame:
        ask = retried(make(), **retry)
        return pd.DataFrame([ask(p) for p in prompt], columns=["text", "input_tokens", "output_tokens"])

    return run


def usage(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """One row: requests and the tokens that replies (a struct as of ``complete``) took."""
    n = lambda c: F.coalesce(F.sum(f"{reply}.{c}"), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("requests"), n("input_tokens"), n("output_tokens"))
