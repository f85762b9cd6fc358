"""Evidence for answers: a character budget filled in two passes, places in earlier versions, labels; and what answers cite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text

def earlier_places(revisions: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """revisions (place, document_id, version, chunk_index: of the newer chunk) with the chunk of the earlier version that shares most words with it.

    versions: (document_id, version, content). The earlier text is cut as texts are cut for embedding; the share is that of common words among all
    of both chunks, ties to the first. Gives place, document_id, based_on_version, chunk_index, content.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    newer = chunks.select("document_id", F.col("version").alias("newer"), "chunk_index", words(F.col("content")).alias("now"))
    asked = revisions.select("place", "document_id", "version", "chunk_index", (F.col("version") + 1).alias("newer")).join(newer, ["document_id", "newer", "chunk_index"], "left")
    asked = asked.withColumn("now", F.coalesce("now", F.array().cast("array<string>")))
    wanted = versions.join(asked.select("document_id", "version").distinct(), ["document_id", "version"], "left_semi")
    cut = text.chunk_documents(wanted.select(F.struct("document_id", "version").alias("id"), "content"))
    cut = cut.select("id.document_id", "id.version", F.col("chunk_index").alias("earlier"), F.col("content").alias("earlier_content"))
    met = asked.select("place", "document_id", "version", "now").join(cut, ["document_id", "version"])
    both, either = F.size(F.array_intersect("now", words(F.col("earlier_content")))), F.size(F.array_union("now", words(F.col("earlier_content"))))
    scored = met.withColumn("share", F.coalesce(F.try_divide(both, either), F.lit(0.0)))
    best = scored.groupBy("place", "document_id", "version").agg(F.min_by(F.struct("earlier", "earlier_content"), F.struct(-F.col("share"), F.col("earlier"))).alias("b"))
    return best.select("place", "document_id", F.col("version").alias("based_on_version"), F.col("b.earlier").alias("chunk_index"), F.col("b.earlier_content").alias("content"))


def _stripped(content: str, begin: int, end: int) -> tuple[int, int]:
    inner = content[begin:end]
    lead = len(inner) - len(inner.lstrip())
    return (begin + lead, begin + lead + len(inner.strip())) if inner.strip() else (end, end)


def fill(passages: list[tuple[str, int, int]], budget: int) -> list[tuple[int, int, int]]:
    """(number, begin, end) of the stretches of passages (content, focus from and to) that fit a budget of characters.

    First the focus of each in order: a repeated text is passed over, and so is one that no longer fits, but for the first, which is cut. What is
    left of the budget then widens them in order, each around its focus.
    """
    taken: list[list] = []
    seen: set[str] = set()
    for number, (content, begin, end) in enumerate(passages):
        whole = content.strip()
        if budget <= 0 or not whole or whole in seen:
            continue
        begin, end = _stripped(content, begin, end)
        if taken and end - begin > budget:
            continue
        seen.add(whole)
        taken.append([number, begin, end, begin, min(end, begin + budget)])
        budget -= taken[-1][4] - begin
    for entry in taken:
        if budget <= 0:
            break
        number, focus_from, focus_to, begin, end = entry
        room, length = end - begin + budget, len(passages[number][0])
        if focus_to - focus_from >= room:
            entry[3:] = focus_from, focus_from + room
        else:
            size = min(room, length)
            spare = size - (focus_to - focus_from)  # half of it goes before the focus, as far as the text has room there
            _, start, _ = sorted((0, focus_from - spare // 2, length - size))
            entry[3:] = start, start + size
        budget -= entry[4] - entry[3] - (end - begin)
    return [(number, begin, end) for number, _, _, begin, end in taken]


def evidence(passages: DataFrame, budget: int, query: str = "query_id") -> DataFrame:
    """(query, label, document_id, title, chunk_index, based_on_version, current_version, revised, content) of each query's evidence.

    passages: query, place (of the hit), passage (within it), document_id, title, chunk_index, based_on_version, current_version (null: no longer seen),
    content, focus_from, focus_to (null: the whole). A query's passages are its k hits' own, eight a hit at most, and fill one budget in order.
    """
    kind = passages.schema[query].dataType.simpleString()
    out = f"{query} {kind}, label long, document_id long, title string, chunk_index long, based_on_version long, current_version long, revised boolean, content string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "passage"], kind="stable").reset_index(drop=True)
        whole = [(r.content or "", 0 if pd.isna(r.focus_from) else int(r.focus_from), len(r.content or "") if pd.isna(r.focus_to) else int(r.focus_to)) for r in rows.itertuples()]
        made = []
        for number, begin, end in fill(whole, budget):
            r = rows.iloc[number]
            if not pd.isna(r.current_version):
                made.append((r[query], len(made) + 1, r.document_id, r.title, r.chunk_index, r.based_on_version, r.current_version, r.based_on_version < r.current_version, whole[number][0][begin:end].strip()))
        return pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return passages.groupBy(query).applyInPandas(run, out)


def cited(answers: DataFrame, labels: DataFrame, query: str = "query_id") -> DataFrame:
    """labels (query, label, ...) with cited: whether the answer (query, answer) of the query names the label in brackets."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("long")))
    return labels.join(answers.select(query, numbers.alias("_cited")), query, "left").withColumn("cited", F.coalesce(F.array_contains("_cited", F.col("label").cast("long")), F.lit(False))).drop("_cited")


# Fixed value: what an answer says that finds nothing in its evidence.
REFUSAL = "근거 문서에서 찾을 수 없습니다"


def compact(said: Column) -> Column:
    """A text with single blanks and without the commas of thousands."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(said, F.lit("")), r"\s+", " ")), r"(?<=[0-9]),(?=[0-9])", "")


def key_pattern(key: Column) -> Column:
    """What finds a key whatever the blanks in it, but for blanks between digits, and never inside a longer number."""
    chars = F.filter(F.split(F.regexp_replace(compact(key), r"\s", ""), ""), lambda c: c != "")
    digit = lambda c: c.rlike("^[0-9]$")
    last = F.size(chars) - 1
    after = lambda c, i: F.when(i == last, "").when(digit(c) & digit(F.get(chars, i + 1)), "").otherwise(r"\s?")
    body = F.array_join(F.transform(chars, lambda c, i: F.concat(F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1"), after(c, i))), "")
    return F.concat(F.when(digit(F.get(chars, F.lit(0))), r"(?<![0-9.])").otherwise(""), body, F.when(digit(F.get(chars, last)), r"(?!\.?[0-9])").otherwise(""))


def holds_all(said: Column, keys: Column) -> Column:
    """Whether a compact text holds every key of an array; null for no keys."""
    return F.when(F.size(keys) > 0, F.forall(keys, lambda k: F.rlike(said, key_pattern(k))))


def grade(items: DataFrame, sources: DataFrame, relevant: DataFrame, query: str = "query_id") -> DataFrame:
    """A row of judgements for each of items (query, answerable, status, answer, keys, absent).

    sources: (query, label, document_id, content, revised, cited) as given to the answer; relevant: (query, document_id). keys_in_sources tells whether
    the evidence held the keys, given_relevant and cited_relevant whether it held, and the answer cites, a relevant document; leaks are absent texts said.
    """
    told = sources.join(relevant.select(query, "document_id", F.lit(True).alias("_r")).distinct(), [query, "document_id"], "left").withColumn("_r", F.coalesce("_r", F.lit(False)))
    summed = told.groupBy(query).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "content"))), lambda s: s["content"]), " ").alias("_given"), F.bool_or("_r").alias("_any"), F.bool_or(F.col("_r") & F.col("cited")).alias("_cited"), F.count_if(F.col("cited") & ~F.col("_r")).alias("_outside"),
    )
    asked = relevant.select(query).distinct().withColumn("_asked", F.lit(True))
    met = items.join(summed, query, "left").join(asked, query, "left")
    said = compact(F.col("answer"))
    where_asked = lambda c: F.when(F.col("_asked"), F.coalesce(c, F.lit(False)))
    return met.select(
        query, "answerable", "status", holds_all(said, F.col("keys")).alias("key_hit"), holds_all(compact(F.col("_given")), F.col("keys")).alias("keys_in_sources"), where_asked(F.col("_any")).alias("given_relevant"),
        where_asked(F.col("_cited")).alias("cited_relevant"), F.when(F.col("_asked"), F.coalesce("_outside", F.lit(0))).otherwise(0).alias("cited_outside"),
        ((F.col("status") == "no_evidence") | F.rlike(said, key_pattern(F.lit(REFUSAL)))).alias("refused"), F.size(F.filter("absent", lambda k: F.rlike(said, key_pattern(k)))).alias("leaks"),
    )


def summary(graded: DataFrame) -> DataFrame:
    """One row of counts over judgements."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    hit = F.coalesce("key_hit", F.lit(False))
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return graded.agg(
        F.count("*").alias("queries"), n(yes, "answerable"), n(yes & F.col("key_hit").isNotNull(), "key_graded"), n(yes & hit, "key_hits"), n(yes & F.col("keys_in_sources"), "keys_in_sources"), n(yes & F.col("keys_in_sources") & ~hit, "model_misses"),
        n(yes & F.col("given_relevant"), "given_relevant"), n(yes & F.col("cited_relevant"), "cited_relevant"), n(yes & F.col("refused") & ~hit, "false_refusals"), n(no, "no_answer"), n(no & F.col("refused"), "correct_refusals"), n(F.col("leaks") > 0, "leaks"),
    )
