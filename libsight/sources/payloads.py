"""Landed payloads (JSON, Atom XML, model replies) into tables.

Payload tables have a key column and a ``payload`` string.  Malformed payloads
yield no rows; nothing fails a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions import text as tx
from libsight.operators.ranks import overlay_map

_AUTHORS = "authors array<struct<name:string>>"
_IDS = "externalIds struct<DOI:string>"


def _authors(paper: Column) -> Column:
    names = F.transform(paper["authors"], lambda a: a["name"])
    return F.coalesce(F.array_join(F.slice(names, 1, 3), ", "), F.lit(""))


def references(landed: DataFrame, key: str = "item_key") -> DataFrame:
    """Reference lists: title, DOI, year, first three authors, citation count."""
    schema = (f"data array<struct<citedPaper:struct<paperId:string,title:string,year:int,"
              f"citationCount:bigint,{_colon(_AUTHORS)},{_colon(_IDS)}>>>")
    papers = landed.select(key, F.explode(F.from_json("payload", schema)["data"]).alias("d"))
    paper = F.col("d")["citedPaper"]
    title = tx.strip(F.coalesce(paper["title"], F.lit("")))
    return (papers.where(paper.isNotNull()).select(
        F.col(key).alias("citing_key"), title.alias("title"),
        paper["externalIds"]["DOI"].alias("doi"), paper["year"].alias("year"),
        _authors(paper).alias("authors"), paper["citationCount"].alias("citations"),
        paper["paperId"].alias("paper_id")).where(F.length("title") > 6))


def _colon(field: str) -> str:
    name, _, kind = field.partition(" ")
    return f"{name}:{kind}"


# Where each source keeps its counts and what the counts are called.
COUNT_FIELDS = {
    "semanticscholar": (("Total(S2)", "$.citationCount"),
                        ("Highly Influential", "$.influentialCitationCount")),
    "openalex": (("Total(OA)", "$.cited_by_count"),),
    "crossref": (("Total(CR)", "$.message.is-referenced-by-count"),),
}
INTENTS = {"background": "Background", "methodology": "Methods", "result": "Results"}


def citation_counts(landed: DataFrame) -> DataFrame:
    """Long table ``item_key, source, label, value, fetched_on`` from three payload shapes."""
    body = F.when((F.col("source") == "openalex") & F.get_json_object("payload", "$.results").isNotNull(),
                  F.get_json_object("payload", "$.results[0]")).otherwise(F.col("payload"))
    rows = landed.withColumn("_body", body).where(
        F.col("_body").isNotNull() & F.try_parse_json("_body").isNotNull())
    parts = []
    for source, fields in COUNT_FIELDS.items():
        for label, path in fields:
            value = F.coalesce(F.get_json_object("_body", _quoted(path)), F.lit("0"))
            parts.append(F.when(F.col("source") == source, F.struct(
                F.lit(label).alias("label"), value.alias("value"))))
    listed = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return rows.select("item_key", "source", F.to_date("fetched_at").alias("fetched_on"),
                       F.explode(listed).alias("p")).select(
        "item_key", "source", "p.label", "p.value", "fetched_on")


def _quoted(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split(".")[1:])


def intent_tally(landed: DataFrame) -> DataFrame:
    """Citations by intent per item, intents that never occur left out."""
    entries = landed.select("item_key", F.explode(F.from_json(
        "payload", "data array<struct<intents:array<string>>>")["data"]).alias("e"))
    intents = entries.select("item_key", F.explode("e.intents").alias("intent"))
    names = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    return (intents.select("item_key", names[F.col("intent")].alias("label"))
            .where("label is not null").groupBy("item_key", "label")
            .agg(F.count("*").alias("value")))


def findings_json(landed: DataFrame, source: str = "Semantic Scholar") -> DataFrame:
    """New papers of citation and search payloads: id, title, authors, year, url."""
    paper = f"paperId:string,title:string,year:int,{_colon(_AUTHORS)},{_colon(_IDS)}"
    schema = f"data array<struct<citingPaper:struct<{paper}>,{paper}>>"
    rows = landed.select("watch_id", F.explode(F.from_json("payload", schema)["data"]).alias("d"))
    p = F.coalesce(F.col("d")["citingPaper"], F.struct(*[
        F.col("d")[n].alias(n) for n in ("paperId", "title", "year", "authors", "externalIds")]))
    found = rows.select("watch_id", p.alias("p")).where("p.paperId is not null")
    doi = F.col("p.externalIds.DOI")
    return found.select(
        "watch_id", F.col("p.paperId").alias("finding_id"),
        F.coalesce("p.title", F.lit("")).alias("title"), _authors(F.col("p")).alias("authors"),
        F.col("p.year").alias("year"),
        F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).otherwise(
            F.concat(F.lit("https://www.semanticscholar.org/paper/"), "p.paperId")).alias("url"),
        F.lit(source).alias("source"))


def findings_atom(landed: DataFrame, source: str = "arXiv") -> DataFrame:
    """New papers of Atom feeds; entries without an id drop."""
    entry = F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1)))
    entries = landed.select("watch_id", entry.alias("e"))

    def tag(name: str) -> Column:
        return tx.strip(F.regexp_extract("e", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1))

    names = F.transform(F.slice(F.regexp_extract_all(
        "e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), 1, 3), tx.strip)
    return entries.select(
        "watch_id", tag("id").alias("finding_id"), tx.squeeze(tag("title")).alias("title"),
        F.array_join(names, ", ").alias("authors"),
        F.substring(tag("published"), 1, 4).try_cast("int").alias("year"),
        tag("id").alias("url"), F.lit(source).alias("source")).where("finding_id <> ''")


def rank_records(landed: DataFrame) -> DataFrame:
    """Rank maps per venue: the official map with custom ranks laid over it."""
    schema = ("data struct<officialRank:struct<all:map<string,string>>,"
              "customRank:struct<rankInfo:array<struct<abbName:string,uuid:string,rank:string>>>>")
    empty = F.create_map().cast("map<string,string>")
    # an array of one is exploded where a value is used several times, so that it is made once
    read = landed.select("venue_key", _once(F.from_json("payload", schema)["data"], "_data"))
    named = F.filter(F.col("_data")["customRank"]["rankInfo"], lambda r: (
        F.coalesce(r["abbName"], F.lit("")) != "") & (F.coalesce(r["uuid"], F.lit("")) != ""))
    listed = read.select("venue_key", F.col("_data")["officialRank"]["all"].alias("_all"), _once(named, "_named"))
    keyed = listed.select("*", _once(F.array_distinct(F.transform("_named", lambda r: r["abbName"])), "_keys"))
    # of several ranks under one name the last one counts
    values = F.transform("_keys", lambda k: F.coalesce(F.element_at(
        F.filter("_named", lambda r: r["abbName"] == k), -1)["rank"], F.lit("")))
    custom = keyed.select("venue_key", "_all", _once(F.coalesce(F.map_from_arrays("_keys", values), empty), "_custom"))
    record = overlay_map(F.coalesce("_all", empty), F.col("_custom"))
    return custom.select("venue_key", _once(record, "record")).where(F.size("record") > 0)


def _once(value: Column, name: str) -> Column:
    return F.explode(F.array(value)).alias(name)


# --- replies of models

def json_items(answer: Column | str) -> Column:
    """Elements of the JSON array found in a free-text answer, as variants."""
    piece = F.regexp_extract(tx.col(answer), r"(?s)(\[.*\])", 1)
    whole = F.when(F.try_parse_json(piece).isNotNull(), piece)
    return F.from_json(whole, "array<variant>")


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is_text(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_field(v, name, "variant")) == "STRING", F.lit(False))


def _number(v: Column, name: str) -> Column:
    """A positive number, given as number or as text; else NULL."""
    return F.nullif(_field(v, name, "string").try_cast("double").cast("int"), F.lit(0))


def claims(answers: DataFrame, limit: int = 5, key: str = "item_key") -> DataFrame:
    """Claims of extraction answers: ``key, claim_no, claim, page``."""
    listed = F.filter(json_items("answer"), lambda v: _is_text(v, "claim"))
    return answers.select(key, F.posexplode(F.slice(listed, 1, limit)).alias("claim_no", "v")).select(
        key, "claim_no", tx.strip(_field(F.col("v"), "claim", "string")).alias("claim"),
        _number(F.col("v"), "page").alias("page"))


VERDICTS = ("supports", "contradicts", "unclear", "absent")


def verdicts(answers: DataFrame, keys: Sequence[str] = ("item_key",),
             claim_count: str | None = None) -> DataFrame:
    """Verdicts of judging answers: ``keys, claim_no, verdict, evidence, page``.

    Unknown verdicts count as unclear; claim numbers outside the list drop; of
    several verdicts on one claim the last one counts.
    """
    keep = [*keys] + ([claim_count] if claim_count else [])
    rows = answers.select(*keep, F.posexplode(json_items("answer")).alias("_at", "v")).select(
        *keep, "_at", (_number(F.col("v"), "claim") - 1).alias("claim_no"),
        _field(F.col("v"), "verdict", "string").alias("_verdict"),
        F.substring(F.coalesce(_field(F.col("v"), "evidence", "string"), F.lit("")), 1, 300)
        .alias("evidence"), _number(F.col("v"), "page").alias("page"))
    rows = rows.where("claim_no >= 0")
    if claim_count:
        rows = rows.where(F.col("claim_no") < F.col(claim_count))
    verdict = F.when(F.col("_verdict").isin(*VERDICTS), F.col("_verdict")).otherwise("unclear")
    last = rows.withColumn("verdict", verdict).groupBy(*keys, "claim_no").agg(
        F.max_by(F.struct("verdict", "evidence", "page"), "_at").alias("_c"))
    return last.select(*keys, "claim_no", "_c.*")


def passages(answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Quotes a model picked: ``key, page (1-based), quote, comment``."""
    listed = F.filter(json_items("answer"), lambda v: _is_text(v, "quote") & (
        F.length(_field(v, "quote", "string")) > 8))
    return answers.select(key, F.explode(listed).alias("v")).select(
        key, F.coalesce(_number(F.col("v"), "page"), F.lit(1)).alias("page"),
        tx.strip(_field(F.col("v"), "quote", "string")).alias("quote"),
        tx.strip(F.coalesce(_field(F.col("v"), "comment", "string"), F.lit(""))).alias("comment"))


def list_reply(answer: Column | str, most: int = 10) -> Column:
    """Short entries of a comma or line list, bullets and numbers stripped."""
    parts = F.transform(F.split(tx.col(answer), r"[,\n、]"), lambda p: tx.strip(
        F.regexp_replace(p, rf"^[-*\d.{tx.SPACE}]+", "")))
    return F.slice(F.filter(parts, lambda p: (F.length(p) > 1) & (F.length(p) < 40)), 1, most)


def numbered_blocks(answer: Column | str, count: Column | int) -> Column:
    """Bodies of ``<<n>>`` blocks by position, '' where skipped, NULL if there is none."""
    a = tx.col(answer)
    n = F.lit(count) if isinstance(count, int) else count
    pattern = rf"<<(\d+)>>[{tx.SPACE}]*([\s\S]*?)(?=\n?<<\d+>>|\z)"
    numbers = F.regexp_extract_all(a, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(a, F.lit(pattern), F.lit(2))
    blocks = F.filter(F.arrays_zip(numbers.alias("no"), bodies.alias("body")), lambda z: (
        z["no"].try_cast("int").between(1, n)))

    def body(i: Column) -> Column:
        own = F.filter(blocks, lambda z: z["no"].cast("int") == i)
        return F.when(F.size(own) > 0, tx.strip(F.element_at(own, -1)["body"])).otherwise(F.lit(""))

    return F.when(F.size(blocks) > 0, F.transform(F.sequence(F.lit(1), n), body))


# Payload shapes of model responses.
_BLOCKS = "content array<struct<type:string,text:string>>, stop_reason string"
_CHOICES = "choices array<struct<message:struct<content:string>,text:string,finish_reason:string>>"


def model_answer(payload: Column | str, shape: Column | str) -> Column:
    """Struct (answer, truncated) of a whole response; reasoning is no part of the answer.

    ``shape`` is ``blocks`` (a list of content blocks) or ``choices``.  A
    payload that is no JSON is taken as the answer itself.
    """
    p, s = tx.col(payload), tx.col(shape)
    is_json = F.try_parse_json(p).isNotNull()
    blocks, choices = F.from_json(p, _BLOCKS), F.from_json(p, _CHOICES)
    texts = F.transform(F.filter(blocks["content"], lambda b: b["type"] == "text"),
                        lambda b: b["text"])
    first = F.try_element_at(choices["choices"], F.lit(1))
    answer = F.when(s == "blocks", F.array_join(texts, "")).otherwise(
        F.coalesce(first["message"]["content"], first["text"]))
    stopped = F.when(s == "blocks", blocks["stop_reason"] == "max_tokens").otherwise(
        first["finish_reason"] == "length")
    return F.struct(
        F.when(is_json, F.coalesce(answer, F.lit(""))).otherwise(p).alias("answer"),
        F.coalesce(is_json & stopped, F.lit(False)).alias("truncated"))


_BLOCK_EVENT = "type string, delta struct<text:string,stop_reason:string>, stop_reason string"
_CHOICE_EVENT = ("choices array<struct<delta:struct<content:string>,message:struct<content:string>,"
                 "text:string,finish_reason:string>>")


def stream_event(payload: Column | str, shape: Column | str) -> Column:
    """Struct (piece, truncated) of one event of a streamed response."""
    p, s = tx.col(payload), tx.col(shape)
    block, choice = F.from_json(p, _BLOCK_EVENT), F.from_json(p, _CHOICE_EVENT)
    first = F.try_element_at(choice["choices"], F.lit(1))
    spoken = F.when(first["delta"].isNotNull(), first["delta"]["content"]).otherwise(
        F.coalesce(first["message"]["content"], first["text"]))
    piece = F.when(s == "blocks", F.when(block["type"] == "content_block_delta",
                                         block["delta"]["text"])).otherwise(spoken)
    stopped = F.when(s == "blocks", F.coalesce(
        block["delta"]["stop_reason"], block["stop_reason"]) == "max_tokens").otherwise(
        first["finish_reason"] == "length")
    return F.struct(F.coalesce(piece, F.lit("")).alias("piece"),
                    F.coalesce(stopped, F.lit(False)).alias("truncated"))


def stream_answers(events: DataFrame) -> DataFrame:
    """Whole answers of streamed responses (``response_id, seq, shape, payload``)."""
    parts = events.withColumn("_e", stream_event("payload", "shape"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_e.piece"))),
                         lambda s: s["piece"])
    return parts.groupBy("response_id").agg(F.array_join(pieces, "").alias("answer"),
                                            F.bool_or("_e.truncated").alias("truncated"))


# --- failures of calls

# What the body of a failed call says about the cause, first match wins.
QUOTA = (r"(?i)insufficient.?(?:quota|balance|credit|fund)|余额|欠费|quota.?exceeded|billing"
         r"|credit balance|payment required|arrear")
CONTEXT = (r"(?i)context.?(?:length|window)|maximum context|too many tokens|prompt is too long"
           r"|input is too long|exceeds?.{0,20}(?:limit|length)|上下文|过长")
MODEL_FAULT = (r"(?i)not.?(?:exist|found|support|available)|does not exist|invalid|unknown|no such"
               r"|不存在|无效|不支持|未开通")
AUTH = (r"(?i)invalid.{0,12}(?:api.?key|token|auth)|incorrect api key|unauthori[sz]ed"
        r"|authentication|鉴权|密钥|api key")
DETAIL_PATHS: Sequence[str] = ("$.error.message", "$.error", "$.message", "$.msg", "$.detail",
                               "$.error_msg")


def failure_detail(body: Column | str) -> Column:
    """The message a JSON error body carries; the body itself otherwise, unless it is markup."""
    b = F.coalesce(tx.col(body), F.lit(""))
    said = []
    for path in DETAIL_PATHS:
        value = F.get_json_object(b, path)
        if path == "$.error":
            value = F.when(~value.rlike(r"^[\[{]"), value)
        said.append(F.nullif(value, F.lit("")))
    return F.coalesce(*said, F.when(b.rlike(rf"^[{tx.SPACE}]*<"), F.lit("")).otherwise(tx.strip(b)))


def failure_kind(status: Column | str, body: Column | str) -> Column:
    """Cause of a failed call as something a user can act on."""
    s = tx.col(status)
    said = F.concat_ws(" ", failure_detail(body), F.substring(
        F.coalesce(tx.col(body), F.lit("")), 1, 600))
    return (F.when(said.rlike(QUOTA) | s.isin(402, 456), "quota")
            .when(said.rlike(CONTEXT), "context")
            .when(said.rlike("(?i)model") & said.rlike(MODEL_FAULT), "model")
            .when((s == 401) | said.rlike(AUTH), "auth")
            .when(s == 403, "auth").when(s == 429, "rate").when(s.isin(404, 405), "address")
            .when(s >= 500, "server").when(s >= 400, "rejected").otherwise("other"))


def failure_triage(calls: DataFrame) -> DataFrame:
    return (calls.withColumn("kind", failure_kind("status", "body"))
            .groupBy("kind").agg(F.count("*").alias("n")))
