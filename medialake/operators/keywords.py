"""Keywords of a dictionary in names: one automaton pass a name, whatever the size of the dictionary.

A dictionary is a list of category rules (name, keywords by commas, matchMode, enabled). Its spellings, keywords with their plural
or singular, go to the workers by a broadcast of at most MAX_SPELLINGS; each process builds an Aho-Corasick automaton of those that may
stand anywhere (`contains`) and a table of those that must be a token (`wholeWord`: the same tokens as `name_tokens`). So a name is read once and the
plan has one projection for ten keywords as for a hundred thousand. The longest keyword wins, then the earliest. Distinct names only
are looked up.

Defined cases: null names count as empty and have no keyword; an empty dictionary finds nothing; keywords that are empty or only
white space are left out; a spelling of several keywords stands for the longest, then the earliest; categories' affixes are not taken off a
name first (`strip_affix` does); other columns are kept, and columns called category or keyword are replaced.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import keyword_variants, name_chunks, name_parts

#: Spellings that a broadcast dictionary may have; about 200 bytes each in a worker.
MAX_SPELLINGS = 2_000_000
_HIT = "struct<category:string,keyword:string>"


def spellings(categories: list[dict]) -> list[tuple[str, bool, int, int, str, str]]:
    """(spelling, whole word, length, -order, category, keyword) of enabled category rules, the best entry of each spelling."""
    best: dict[tuple[str, bool], tuple[int, int, str, str]] = {}
    order = 0
    for c in categories:
        if not c.get("enabled", True):
            continue
        whole = c.get("matchMode", "wholeWord") == "wholeWord"
        for keyword in filter(None, (k.strip() for k in c.get("keywords", "").split(","))):
            order += 1
            entry = (len(keyword), -order, c.get("name", ""), keyword)
            for v in keyword_variants(keyword):
                best[v, whole] = max(best.get((v, whole), entry), entry)
    if len(best) > MAX_SPELLINGS:
        raise ValueError(f"a dictionary of {len(best)} spellings; at most {MAX_SPELLINGS} are broadcast")
    return [(v, whole, *entry) for (v, whole), entry in best.items()]


def _automaton(entries) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for v, _, length, order, category, keyword in entries:
        found.add_word(v, (length, order, category, keyword))
    found.make_automaton()
    return found


def with_category(df: DataFrame, name: str, categories: list[dict]) -> DataFrame:
    """df with category and keyword of the longest keyword in the column name, nulls where there is none."""
    shared = df.sparkSession.sparkContext.broadcast(spellings(categories))
    ready: list = []

    def matchers():
        # Once a worker process: the closure is unpickled there with an empty list.
        if not ready:
            whole = {e[0]: e[2:] for e in shared.value if e[1]}
            inside = [e for e in shared.value if not e[1]]
            ready.append((whole, _automaton(inside) if inside else None))
        return ready[0]

    @F.pandas_udf(_HIT)
    def best(names: pd.Series, chunks: pd.Series, parts: pd.Series) -> pd.DataFrame:
        whole, automaton = matchers()
        out = []
        for text, words, more in zip(names, chunks, parts):
            words = list(words)
            runs = (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
            hits = [whole[t] for t in {*runs, *more} if t in whole]
            if automaton is not None:
                hits += [entry for _, entry in automaton.iter(text)]
            out.append(max(hits)[2:] if hits else (None, None))
        return pd.DataFrame(out, columns=["category", "keyword"], dtype=object)

    text, lower = F.coalesce(F.col(name), F.lit("")), lambda words: F.transform(words, lambda w: F.lower(w))
    distinct = df.select(text.alias("_name")).distinct()
    placed = distinct.withColumn("_hit", best(F.lower("_name"), lower(name_chunks(F.col("_name"))), lower(name_parts(F.col("_name")))))
    out = df.withColumn("_name", text).join(placed, "_name").drop("_name")
    return out.withColumns({"category": F.col("_hit.category"), "keyword": F.col("_hit.keyword")}).drop("_hit")
