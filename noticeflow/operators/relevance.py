"""Which documents are about which notices, from their texts: candidates by blocking keys, then the ladder of ``linkage.relevance``.

Words are looked for anywhere in a document's text (``substrings``), once for each document and whatever the number of notices. Candidates
are pairs with a key in common. A notice that states numbers needs one of them, so numbers are its only keys. One that needs two
words in common can leave out the word that most documents have: whoever shares two of its words shares one of
the others. One that needs a single word keeps them all. So no relevant pair is lost, and the most frequent words make few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.text import has_any, normalised
from noticeflow.operators import linkage, substrings
from noticeflow.operators.substrings import Checkpoint

UNKNOWN_AREA = "nao identificada"
_DATES = ("publication_date", "registration_start", "registration_end", "first_seen")
_NONE = "array<string>"


def _own(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def prepared_notices(notices: DataFrame, key: str) -> DataFrame:
    """(key, numbers, area, area_words, institution_words, title_words) of notices.

    Columns that are read, each of which may be missing: labels (array), title, body, description, area, institution and the
    dates of ``_DATES``. An area that isn't known is empty.
    """
    text = lambda *names: F.concat_ws(" ", *[_own(notices, n) for n in names])
    labels = F.coalesce(_own(notices, "labels", _NONE), F.array().cast(_NONE))
    area = normalised(_own(notices, "area"))
    first = notices.select(
        key,
        linkage.known_numbers(labels, text("title", "body", "description"), linkage.notice_year([_own(notices, d) for d in _DATES])).alias("numbers"),
        F.when(area == UNKNOWN_AREA, "").otherwise(area).alias("area"),
        linkage.tokens(_own(notices, "institution"), (*linkage.COMMON_WORDS, *linkage.INSTITUTION_WORDS)).alias("institution_words"),
        linkage.tokens(text("title", "description")).alias("title_words"),
    )
    return first.withColumn("area_words", linkage.tokens(F.col("area")))


def prepared_documents(documents: DataFrame, key: str, text_col: str = "text", url_col: str = "url") -> DataFrame:
    """(key, said, address, numbers, selects, teaches) of documents, whole texts normalised."""
    said = documents.select(key, normalised(F.col(text_col)).alias("said"), normalised(_own(documents, url_col)).alias("address"))
    return said.select("*", linkage.loose_numbers(F.col("said")).alias("numbers"), has_any(F.col("said"), linkage.SELECTION_WORDS).alias("selects"), has_any(F.col("said"), linkage.TEACHING_WORDS).alias("teaches"))


def found_words(documents: DataFrame, notices: DataFrame, key: str, checkpoint: Checkpoint) -> DataFrame:
    """The documents without their texts, with the words of any notice that stand in the text (``found``) and in the address (``found_url``)."""
    phrase = F.when(F.length("area") >= linkage.LEAST_AREA, F.array("area")).otherwise(F.array().cast(_NONE))
    words = notices.select(F.explode(F.concat("area_words", "institution_words", "title_words", phrase)).alias("term")).distinct()
    terms = checkpoint(words, "notice-words")
    hits = substrings.term_hits(documents, terms, key, "said").select(key, F.lit(0).alias("url"), "term")
    hits = hits.unionByName(substrings.term_hits(documents, terms, key, "address").select(key, F.lit(1).alias("url"), "term"))
    each = hits.groupBy(key).agg(*[F.collect_set(F.when(F.col("url") == k, F.col("term"))).alias(n) for k, n in enumerate(("found", "found_url"))])
    none = F.array().cast(_NONE)
    joined = documents.drop("said", "address").join(each.hint("merge"), key, "left")
    return joined.withColumns({n: F.coalesce(n, none) for n in ("found", "found_url")})


def candidates(notices: DataFrame, documents: DataFrame, notice_key: str, document_key: str, checkpoint: Checkpoint) -> DataFrame:
    """(notice, document): all pairs that the ladder can accept, and few others.

    ``documents`` have ``found`` words. A key of very many notices and documents gives as many pairs, for each of these is then
    relevant by the rule of a single number or word; the merge join splits such a key at run time.
    """
    good = documents.filter(F.col("selects") & F.col("teaches"))
    seen = checkpoint(good.select(document_key, F.explode(F.array_union("found", "found_url")).alias("term")), "found-words")
    frequency = seen.groupBy("term").agg(F.count(F.lit(1)).alias("nf_n"))
    free = notices.filter(F.size("numbers") == 0)
    known = F.col("area") != ""
    two = F.when(known & (F.size("area_words") >= 2), F.col("area_words")).when(~known, F.col("title_words")).otherwise(F.array().cast(_NONE))
    one = (
        F.when(~known, F.col("institution_words"))
        .when(F.size("area_words") == 1, F.col("area_words"))
        .when((F.size("area_words") == 0) & (F.length("area") >= linkage.LEAST_AREA), F.array("area"))
        .otherwise(F.array().cast(_NONE))
    )
    pairs_of = free.select(notice_key, F.explode(two).alias("term")).join(frequency.hint("merge"), "term")  # words of no document go
    most = Window.partitionBy(notice_key).orderBy(F.desc("nf_n"), "term")
    rarer = pairs_of.withColumn("nf_k", F.row_number().over(most)).filter("nf_k > 1").select(notice_key, "term")
    single = free.select(notice_key, F.explode(one).alias("term"))
    by_word = rarer.unionByName(single).distinct().join(seen.hint("merge"), "term").select(notice_key, document_key)
    stated = notices.select(notice_key, F.explode("numbers").alias("number"))
    by_number = stated.join(good.select(document_key, F.explode("numbers").alias("number")).hint("merge"), "number").select(notice_key, document_key)
    return by_word.unionByName(by_number).distinct()


def assessed(pairs: DataFrame, notices: DataFrame, documents: DataFrame, notice_key: str, document_key: str) -> DataFrame:
    """(notice, document, relevant, reason, common) of given pairs; ``common`` are the words that speak for the pair, sorted."""
    left = notices.withColumnRenamed("numbers", "own")
    both = pairs.join(left.hint("merge"), notice_key).join(documents.hint("merge"), document_key)
    area = F.array_intersect("area_words", "found")
    institution = F.array_intersect("institution_words", "found")
    title = F.array_intersect("title_words", F.array_union("found", "found_url"))
    exact = (F.length("area") >= linkage.LEAST_AREA) & F.array_contains("found", F.col("area"))
    good, why = linkage.relevance(
        F.col("own"), F.col("numbers"), F.col("area") != "", exact, F.size(area), F.size("area_words"), F.size(institution) > 0, F.size(title), F.col("selects"), F.col("teaches")
    )
    shared = F.array_intersect("own", "numbers")
    common = F.when(why == "same number", shared).when(why == "area", area).when(why == "institution", institution).when(why == "title words", title)
    return both.select(notice_key, document_key, good.alias("relevant"), why.alias("reason"), F.array_sort(F.coalesce(common, F.array().cast(_NONE))).alias("common"))


def relevant_documents(notices: DataFrame, documents: DataFrame, notice_key: str, document_key: str, checkpoint: Checkpoint, text_col: str = "text", url_col: str = "url") -> DataFrame:
    """(notice, document, reason, common) of all pairs of notices and documents of which the ladder says that they belong together."""
    own = checkpoint(prepared_notices(notices, notice_key), "notices")
    read = checkpoint(prepared_documents(documents, document_key, text_col, url_col), "documents")
    found = checkpoint(found_words(read, own, document_key, checkpoint), "documents-found")
    pairs = candidates(own, found, notice_key, document_key, checkpoint)
    return assessed(pairs, own, found, notice_key, document_key).filter("relevant").drop("relevant")
