"""Detectors that may only add: a named-entity recogniser and a language model. What they fail at is left out, and the
deterministic result stays as it is. No text goes into logs or errors."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import additions, chunks, is_loopback, model_type, ner_type, prompt, trimmed
from ..functions.scan import between, held, literal, none, span, starts

log = logging.getLogger(__name__)
_ENTS = "array<struct<start:int,end:int,label:string>>"
MIN_SURFACE, MAX_SURFACE = 2, 40


def load_recogniser(model: str) -> Callable | None:
    """text -> [(start, end, label)] by a spaCy model, or None, said once, if that isn't there."""
    try:
        import spacy

        nlp = spacy.load(model)
    except Exception as e:
        log.warning("the recogniser is off (%s); the other layers remain", type(e).__name__)
        return None
    return lambda text: [(e.start_char, e.end_char, e.label_) for e in nlp(text).ents]


_LOADED: dict = {}
_SAID: set[tuple[str, str]] = set()


def _say(message: str, what: str) -> None:
    """A warning once for each kind of failure in a worker: a corpus may fail a million times alike."""
    (log.debug if (message, what) in _SAID else log.warning)(message, what)
    _SAID.add((message, what))


def ner_spans(text: Column, recogniser: Callable | str, score: float = 0.5, types: tuple[str, ...] = (K.PERSON, K.ORGANIZATION)) -> Column:
    """Spans of a recogniser, a function or the name of a model that each worker loads once."""
    what = recogniser

    @F.pandas_udf(_ENTS)
    def run(texts: pd.Series) -> pd.Series:
        if isinstance(what, str):
            if what not in _LOADED:
                _LOADED[what] = load_recogniser(what)
            found = _LOADED[what]
        else:
            found = what

        def one(t):
            if not t or found is None:
                return []
            try:
                return [{"start": int(a), "end": int(b), "label": str(n)} for a, b, n in found(t)]
            except Exception as e:
                _say("the recogniser failed on a text (%s); such texts are skipped", type(e).__name__)
                return []

        return texts.map(one)

    return entity_spans(text, run(text), score, types)


def entity_spans(text: Column, entities: Column, score: float = 0.5, types: tuple[str, ...] = (K.PERSON, K.ORGANIZATION)) -> Column:
    """Spans of recognised entities array<struct<start, end, label>>: known labels of the wanted types, without white
    space at their ends."""

    def one(e):
        first, last = trimmed(text, e["start"], e["end"])
        return span(first, last, ner_type(e["label"]), F.lit(score), F.array(F.lit("ner")))

    return F.filter(F.transform(entities, one), lambda s: s["type"].isin(*types) & (s["start"] < s["end"]))


def check_endpoint(url: str, allow_remote: bool = False) -> None:
    """Refuses, before any data moves, an endpoint that isn't on this machine."""
    if not (allow_remote or is_loopback(url)):
        raise ValueError("the model's endpoint isn't on this machine, and allow_remote isn't set")


def http_client(url: str, model: str, timeout: float = 30.0, allow_remote: bool = False) -> Callable[[str], str]:
    """prompt -> answer by a local model server."""
    check_endpoint(url, allow_remote)

    def ask(question: str) -> str:
        import json
        from urllib import request

        body = json.dumps({"model": model, "prompt": question, "stream": False, "format": "json", "options": {"temperature": 0}}).encode()
        with request.urlopen(request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.loads(answer.read().decode()).get("response", "")

    return ask


def model_spans(text: Column, offset_chunks: Column, answers: Column, types: tuple[str, ...] = (K.PERSON, K.ORGANIZATION)) -> Column:
    """Spans of a model's answers, one for each chunk: every place of the chunk where a named text really stands."""

    def of_chunk(c, answer):
        def of_item(i):
            kind, size = model_type(i["type"]), F.length(i["text"])
            ok = size.between(MIN_SURFACE, MAX_SURFACE) & kind.isin(*types)
            places = F.when(ok, starts(c["chunk"], literal(i["text"]))).otherwise(none("array<int>"))
            return F.transform(places, lambda at: span(c["offset"] + at, c["offset"] + at + size, kind, F.lit(0.4), F.array(F.lit("llm"))))

        return F.flatten(F.transform(additions(answer), of_item))

    return F.flatten(F.zip_with(offset_chunks, answers, of_chunk))


def ask_model(df: DataFrame, client: Callable[[str], str], size: int = 700, text: str = "text", found: str = "spans") -> DataFrame:
    """df with `_more`, the spans that a model adds to `found`. Each chunk is asked about once, with what of it is masked
    already; a chunk whose question fails is skipped."""
    t = F.col(text)

    def known(c):
        end = c["offset"] + F.length(c["chunk"])
        return F.transform(F.filter(F.col(found), lambda s: (s["start"] < end) & (c["offset"] < s["end"])), lambda s: between(t, s["start"], s["end"]))

    df = df.withColumn("_chunks", held(F.when(t == "", none("array<struct<chunk:string,offset:int>>")).otherwise(chunks(t, size))))
    df = df.withColumn("_asked", held(F.transform("_chunks", lambda c: prompt(c["chunk"], known(c)))))

    @F.pandas_udf("array<string>")
    def ask(questions: pd.Series) -> pd.Series:
        def one(q):
            try:
                return client(q)
            except Exception as e:
                _say("a question to the model failed (%s); such chunks are skipped", type(e).__name__)
                return None

        return questions.map(lambda qs: [one(q) for q in qs] if qs is not None else None)

    df = df.withColumn("_answers", ask("_asked"))
    return df.withColumn("_more", held(model_spans(t, F.col("_chunks"), F.col("_answers")))).drop("_chunks", "_asked", "_answers")
