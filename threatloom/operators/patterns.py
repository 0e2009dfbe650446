"""Terms in texts: one automaton over a table of terms, so that thousands of users' terms cost one pass over a text.

A term is matched in ASCII lower case wherever it occurs, overlaps included, and then judged by what stands beside it:
'strict' (no letter or digit on either side), 'word' (nor an underscore), 'plural' (no letter before; behind it an s at
most, then no letter or digit) or 'any'. The table is read in parts of PART_BYTES; a part's automaton is built once a
worker, and texts pass through it in the tasks that read them.

Edge cases: null and empty terms hit nothing; a null text has no hits; a term on several lists, or repeated on one, hits
once for each different (list, boundary); offsets count code points from 0; an empty table of terms gives no hits.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.functions import refdata as R
from threatloom.functions.text import ascii_lower
from threatloom.operators.maps import small_or_dealt
from threatloom.runtime import ship

TERMS = "list_name string, term string, boundary string"
#: Bytes of terms that one automaton holds (its nodes take some hundred times as much).
PART_BYTES = 4 << 20
_BUILT: dict = {}


def spelt(pattern: str) -> list[str]:
    """All strings that literal characters and [classes] spell: 'p[e3]n' is 'pen' and 'p3n'."""
    choices = [list(c[1:-1]) if len(c) > 1 else [c] for c in re.findall(r"\[[^\]]+\]|[^\[]", pattern)]
    return ["".join(x) for x in itertools.product(*choices)]


def fixed_terms(spark) -> DataFrame:
    """The detectors' own term lists as a table of terms."""
    plural = {"gift": R.GIFT, "purchase": R.PURCHASE, "wire": R.WIRE, "urgency": R.URGENCY, "confidential": R.CONFIDENTIAL, "transaction": R.TRANSACTION}
    strict = {"authority": R.AUTHORITY, "social_urgency": R.SOCIAL_URGENCY, "social_action": R.SOCIAL_ACTION}
    rows = [(n, t, "plural") for n, ts in plural.items() for t in ts] + [(n, t, "strict") for n, ts in strict.items() for t in ts]
    return spark.createDataFrame(rows + [("obfuscated", t, "word") for p in R.OBFUSCATED for t in spelt(p)], TERMS)


def fits(boundary: str, text: str, start: int, end: int) -> bool:
    """Whether what stands beside text[start:end] lets a term count."""
    letter = lambda c: c.isascii() and c.isalpha()
    part = lambda c: c.isascii() and c.isalnum()
    before, after, second = text[start - 1 : start] if start else "", text[end : end + 1], text[end + 1 : end + 2]
    if boundary == "any":
        return True
    if boundary == "plural":
        return not letter(before) and (not part(after) or (after in "sS" and not part(second)))
    inner = (lambda c: part(c) or c == "_") if boundary == "word" else part
    return not inner(before) and not inner(after)


def _automaton(number: str, rows: list):
    """The automaton of one part of the terms, built once a worker."""
    if number not in _BUILT:
        import ahocorasick

        a, by_term = ahocorasick.Automaton(), {}
        for name, term, boundary in rows:
            by_term.setdefault(term, []).append((name, boundary))
        for term, lists in by_term.items():
            a.add_word(term, (term, lists))
        a.make_automaton()
        _BUILT.clear()
        _BUILT[number] = a
    return _BUILT[number]


def term_hits(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, list_name, term, offset): where terms (list_name, term, boundary) occur in a column of texts."""
    import uuid

    spark = rows.sparkSession
    ship(spark)
    use = terms.select("list_name", ascii_lower(F.col("term")).alias("term"), F.coalesce("boundary", F.lit("strict")).alias("boundary")).where("term <> ''").distinct()
    size = use.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    parts = -(-size // PART_BYTES)
    of_key = rows.schema[key].dataType.simpleString()
    schema = f"{key} {of_key}, list_name string, term string, offset long"
    texts = rows.select(key, ascii_lower(F.col(text)).alias("_text")).where("_text <> ''")

    def one(k: int) -> DataFrame:
        held = spark.sparkContext.broadcast([tuple(r) for r in use.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()])  # PART_BYTES on average
        number = uuid.uuid4().hex

        def find(batches):
            import pyarrow as pa

            a = _automaton(number, held.value)
            for batch in batches:
                cols: tuple[list, ...] = ([], [], [], [])
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                for i, t in enumerate(texts):
                    for end, (term, lists) in a.iter(t):
                        start = end + 1 - len(term)
                        for name, boundary in lists:
                            if fits(boundary, t, start, end + 1):
                                for c, v in zip(cols, (i, name, term, start), strict=True):
                                    c.append(v)
                arrays = [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "list_name", "term", "offset"])

        return texts.mapInArrow(find, schema)

    out = spark.createDataFrame([], schema)
    for k in range(parts):
        out = out.unionByName(one(k)) if k else one(k)
    return out


def list_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(message_id, symbol, multiplier, options) of hits (message_id, list_name, term) on lists that stand for a symbol
    (list_name, symbol); the options are the terms. For `scan`'s extra symbols."""
    named = hits.join(small_or_dealt(symbols.select("list_name", "symbol").distinct()), "list_name")
    return named.groupBy("message_id", "symbol").agg(F.lit(1.0).alias("multiplier"), F.array_sort(F.collect_set("term")).alias("options"))
