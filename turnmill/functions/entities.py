"""Named entities in tagged words: array<struct<index,term,lemma,pos,ner>>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Entity types and what stands for them; the types that need a number in the term.
ENTITIES = {"PERSON": "<person>", "URL": "<url>", "NUMBER": "<number>", "PERCENT": "<number>", "DURATION": "<number>", "MONEY": "<number>", "DATE": "<time>", "TIME": "<time>"}
NUMERIC = ["DATE", "MONEY", "NUMBER", "TIME", "DURATION", "PERCENT"]
NUMBER = r"^[\-+]?[0-9]+(\.[0-9]+)?"
TAGGED = "array<struct<index:int,term:string,lemma:string,pos:string,ner:string>>"


def normalize_entities(words: Column, entities: dict[str, str] | None = None, lower: bool = True) -> Column:
    """Terms with entities replaced; a placeholder that would follow itself is left out."""
    names = entities or ENTITIES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    term = lambda w: F.lower(w["term"]) if lower else w["term"]

    def step(out: Column, w: Column) -> Column:
        name = F.try_element_at(table, F.coalesce(w["ner"], F.lit("")))
        word = name.isNull() | (w["ner"].isin(*NUMERIC) & ~w["term"].rlike(NUMBER))
        again = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) == name)
        return F.when(word, F.concat(out, F.array(term(w)))).when(again, out).otherwise(F.concat(out, F.array(name)))

    return F.aggregate(words, F.array().cast("array<string>"), step)
