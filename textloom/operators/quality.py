"""Contract checks over result payloads (JSON text), snapshot comparison and coverage. Checks are map-only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.schema import Schema, elements, member, number, string

TOOL = "textloom"

# Fixed values of the output contract.
ANALYZER_NAMES = ("lexical_stats", "pos", "ner", "readability", "keywords", "sentiment", "dependency", "embeddings")
SOURCE_TYPES = ("url", "file", "stdin")

# The keys that identify the result shape of each analyzer.
RESULT_KEYS = {
    "lexical_stats": ("total_tokens",),
    "pos": ("upos_counts",),
    "ner": ("counts_by_label",),
    "readability": ("flesch_reading_ease",),
    "keywords": ("method", "keywords"),
    "sentiment": ("label",),
    "dependency": ("dep_counts",),
    "embeddings": ("vector",),
}

# The properties of each result shape. A scalar has its kind and range, a container the kind of what it holds:
# pairs (a string and a number), texts, numbers, and maps whose keys of the given pattern hold such values.
COUNT, SHARE, ANY = ("integer", 0, None), ("number", 0, 1), ("number", None, None)
RESULT_RULES = {
    "lexical_stats": {"total_tokens": COUNT, "unique_lemmas": COUNT, "sentences": COUNT, "avg_token_length": ("number", 0, None),
                      "avg_sentence_length_tokens": ("number", 0, None), "type_token_ratio": SHARE, "top_lemmas": ("pairs", COUNT)},
    "pos": {"upos_counts": ("map", "^[A-Z]+$", COUNT), "upos_ratios": ("map", "^[A-Z]+$", SHARE),
            "top_lemmas_by_upos": ("map", "^[A-Z]+$", ("pairs", COUNT))},
    "ner": {"supported": ("boolean",), "counts_by_label": ("map", "^[A-Z_]+$", COUNT), "examples_by_label": ("map", "^[A-Z_]+$", ("texts",)),
            "total_entities": COUNT},
    "readability": {"supported": ("boolean",), "note": ("string",), "flesch_reading_ease": ANY, "flesch_kincaid_grade": ANY, "smog_index": ANY,
                    "automated_readability_index": ANY, "coleman_liau_index": ANY, "linsear_write_formula": ANY,
                    "dale_chall_readability_score": ANY, "difficult_words": COUNT, "text_standard": ("string",)},
    "keywords": {"method": ("string",), "keywords": ("pairs", ANY)},
    "sentiment": {"supported": ("boolean",), "label": ("string",), "score": SHARE, "method": ("string",), "model": ("string",),
                  "processing_time": ("number", 0, None), "sampled": ("boolean",), "original_length": COUNT, "sample_length": COUNT,
                  "scores": ("object",), "scores.neg": SHARE, "scores.neu": SHARE, "scores.pos": SHARE, "scores.compound": ("number", -1, 1)},
    "dependency": {"supported": ("boolean",), "dep_counts": ("map", "^[a-z_]+$", COUNT), "head_pos_dep": ("map", "^[A-Z]+->[a-z_]+$", COUNT)},
    "embeddings": {"supported": ("boolean",), "backend": ("string",), "model": ("string",), "dim": COUNT, "normalized": ("boolean",),
                   "vector": ("numbers",)},
}


def _property(rule: tuple) -> dict:
    """JSON Schema of a rule of ``RESULT_RULES``."""
    name = rule[0]
    if name in ("integer", "number"):
        return {"type": name, **{k: v for k, v in zip(("minimum", "maximum"), rule[1:]) if v is not None}}
    if name == "map":
        return {"type": "object", "patternProperties": {rule[1]: _property(rule[2])}}
    if name == "pairs":
        return {"type": "array", "items": {"type": "array", "minItems": 2, "maxItems": 2, "prefixItems": [{"type": "string"}, _property(rule[1])]}}
    if name in ("texts", "numbers"):
        return {"type": "array", "items": {"type": "string" if name == "texts" else "number"}}
    return {"type": name}


def _shape(name: str) -> dict:
    out: dict = {"type": "object", "required": list(RESULT_KEYS[name]), "properties": {}}
    for path, rule in RESULT_RULES[name].items():
        *outer, key = path.split(".")
        node = out
        for step in outer:
            node = node["properties"][step]
        node.setdefault("properties", {})[key] = _property(rule)
    return out


def contract(tool: str = TOOL) -> str:
    """The output contract as JSON Schema text."""
    text, share, count, real = {"type": "string"}, _property(SHARE), _property(COUNT), {"type": "number"}
    of = lambda required=(), **p: {"type": "object", **({"required": list(required)} if required else {}), "properties": p}
    entry = of(("name", "processing_time", "confidence", "results"),
               name={**text, "enum": list(ANALYZER_NAMES)}, processing_time={**real, "minimum": 0}, confidence=share, results={"oneOf": [_shape(n) for n in RESULT_KEYS]},
               metadata=of(language=of(code=text, confidence=share), model=text))
    return json.dumps(of(
        ("tool", "version", "language", "analyzers"), tool={"const": tool}, version=text,
        source=of(type={**text, "enum": list(SOURCE_TYPES)}, value=text, fetched_at=real, domain=text),
        language=of(("code", "confidence", "model"), code=text, confidence=share, model=text),
        content=of(title=text, char_count=count, word_count=count), analyzers={"type": "array", "items": entry}, timing={"type": "object"}))


def _broken(doc: Column, schema: Schema) -> Column:
    """Array of (path, rule) that a payload breaks; one that is not JSON breaks ``json`` only."""
    no_json = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule")))
    return F.when(doc.isNull(), no_json).otherwise(schema.violations(doc))


def payload_violations(payloads: DataFrame, key: str = "doc_id", payload: str = "payload", schema: str | None = None) -> DataFrame:
    """One row per broken rule (key, path, rule) of a JSON Schema text, by default the output contract."""
    rows = payloads.select(key, F.try_parse_json(F.col(payload)).alias("_d"))
    return rows.select(key, F.inline(_broken(F.col("_d"), Schema(schema or contract()))))


def malformed(payloads: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Rows whose payload is not JSON."""
    return payloads.filter(F.try_parse_json(F.col(payload)).isNull()).select(key, F.lit("Invalid JSON").alias("error"))


def analyzer_rows(payloads: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """One row per analyzer entry of every well-formed payload."""
    items = elements(member(F.try_parse_json(F.col(payload)), "analyzers"))
    a = F.col("_a")
    return payloads.select(key, F.posexplode(items).alias("i", "_a")).select(
        key, "i", string(member(a, "name")).alias("name"), number(member(a, "processing_time")).alias("processing_time"),
        number(member(a, "confidence")).alias("confidence"), member(a, "results").alias("results"))


def result_shapes(analyzers: DataFrame, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """How many result shapes match each analyzer entry, with their required keys and the rules of all their properties; exactly one must.

    With ``strict=False`` an entry that declares ``supported: false`` is accepted as a shape of its own.
    """
    shapes = Schema(contract()).at("properties", "analyzers", "items", "properties", "results")
    hits = F.coalesce(shapes.matches(F.col("results")), F.lit(0))
    if not strict:
        refused = F.try_variant_get("results", "$.supported", "boolean") == F.lit(False)
        hits = F.when(F.coalesce(refused, F.lit(False)) & (hits == 0), 1).otherwise(hits)
    return analyzers.select(key, "i", "name", hits.alias("matching_shapes"), (hits == 1).alias("shape_ok"))


def validation_report(payloads: DataFrame, key: str = "doc_id", payload: str = "payload", schema: str | None = None) -> DataFrame:
    """Per payload: validity, number and list of broken rules (``path rule`` by path, joined by semicolons), and the analyzers of valid payloads.

    Each payload is parsed once and judged in its row: no join, no grouping.
    """
    rows = payloads.select(key, F.try_parse_json(F.col(payload)).alias("_d"))
    rows = rows.select(key, "_d", F.array_sort(_broken(F.col("_d"), Schema(schema or contract()))).alias("_e"))
    names = F.transform(elements(member(F.col("_d"), "analyzers")), lambda a: F.coalesce(string(member(a, "name")), F.lit("unknown")))
    valid = F.size("_e") == 0
    said = F.transform("_e", lambda e: F.concat_ws(" ", F.nullif(e["path"], F.lit("")), e["rule"]))
    return rows.select(key, valid.alias("valid"), F.size("_e").cast("long").alias("errors"), F.array_join(said, "; ").alias("error_list"),
                       F.when(valid, F.size(names)).otherwise(0).cast("long").alias("analyzer_count"),
                       F.when(valid, F.array_join(names, ",")).otherwise("").alias("analyzers"))


def validation_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid_files"),
                      F.count_if(~F.col("valid")).alias("invalid_files"))


def golden_diff(actual: DataFrame, golden: DataFrame, digits: int = 6, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Rows found more often in one of two snapshots, after rounding doubles and dropping volatile columns; each as often as it is in excess.

    Every snapshot is read once: its rows count +1 or -1, and one aggregate over all columns leaves the difference.
    """
    def normal(df: DataFrame) -> DataFrame:
        kept = [f for f in df.schema.fields if f.name not in volatile]
        return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
                           else F.col(f.name) for f in kept])

    a, g = normal(actual), normal(golden)
    both = a.withColumn("_sign", F.lit(1)).unionByName(g.withColumn("_sign", F.lit(-1)))
    excess = both.groupBy(*a.columns).agg(F.sum("_sign").alias("_excess")).filter("_excess <> 0")
    side = F.when(F.col("_excess") > 0, "actual").otherwise("golden")
    return excess.select(*a.columns, side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_excess"))).alias("_")).drop("_")


def analyzer_coverage(payloads: DataFrame, required: tuple[str, ...], key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Required analyzers that a payload lacks."""
    present = F.transform(elements(member(F.try_parse_json(F.col(payload)), "analyzers")), lambda a: string(member(a, "name")))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), present)
    return payloads.select(key, (F.size(missing) == 0).alias("passed"), F.array_join(missing, ",").alias("missing"))
