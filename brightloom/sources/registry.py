"""Interfaces to services outside, by name: each has an offline form that gives the same answer every time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions import text as T

Made = TypeVar("Made")


class Registry(Generic[Made]):
    """Factories by name; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str):
        self.kind, self.factories = kind, {}

    def register(self, name: str) -> Callable[[Callable[..., Made]], Callable[..., Made]]:
        def add(factory: Callable[..., Made]) -> Callable[..., Made]:
            self.factories[name] = factory
            return factory

        return add

    def get(self, name: str, **options) -> Made:
        if name not in self.factories:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.factories))}")
        return self.factories[name](**options)


#: Each makes a function from columns to a column.
EMBEDDERS: Registry[Callable[[Column], Column]] = Registry("embedding provider")
RANKERS: Registry[Callable[[Column, Column], Column]] = Registry("rank provider")
SCORERS: Registry[Callable[[Column, Column], Column]] = Registry("scoring provider")


@EMBEDDERS.register("hashed")
def hashed_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Unit vectors of signed hashes of character trigrams."""

    def of(text: Column) -> Column:
        grams = T.ngrams(T.norm(text), 3)
        at = lambda i: F.aggregate(F.filter(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dims)) == i), F.lit(0.0), lambda acc, g: acc + F.when(F.xxhash64(F.lit(1), g) > 0, 1.0).otherwise(-1.0))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at)
        size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
        return F.transform(raw, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))

    return of


@RANKERS.register("overlap")
def overlap_ranker() -> Callable[[Column, Column], Column]:
    """100 times the Dice coefficient of the bigrams of criteria and text."""
    return lambda criteria, text: F.lit(100.0) * T.bigram_dice(T.norm(criteria), T.norm(text))


@SCORERS.register("overlap")
def overlap_scorer() -> Callable[[Column, Column], Column]:
    """A model's JSON answer whose relevance follows the overlap of prompt and text."""

    def of(prompt: Column, text: Column) -> Column:
        relevance = F.bround(F.lit(100.0) * T.bigram_dice(T.norm(prompt), T.norm(text)), 0).cast("int")
        band = F.when(relevance >= 75, "high").when(relevance >= 40, "mid").otherwise("low")
        return F.to_json(F.struct(relevance.alias("relevance"), F.lit(50).alias("quality"), band.alias("band"), F.lit("overlap of bigrams").alias("reason")))

    return of
