"""The rule engine: classifies and summarises documents, with column expressions only.

analysed() adds all fields to a table of file names and texts. Each document is
one row throughout, so nothing is shuffled; what several fields need (the
reflowed body, the phrases found in it, sentences, ranked terms) is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.functions import vocabulary as v

NO_TEXT = "No machine-readable text could be extracted from this file, so the analysis is based on the filename only."
MOST_CANDIDATES, SUMMARY_SENTENCES, TERMS, KEYWORDS = 400, 5, 40, 12


#: All phrases that are looked for in a whole document.
PHRASES = tuple(dict.fromkeys([
    *(w for words in v.DEPARTMENT_KEYWORDS.values() for w in words), *(w for words in v.DOCUMENT_TYPE_KEYWORDS.values() for w in words),
    *(n.lower() for n in v.DOCUMENT_TYPE_KEYWORDS), *v.HIGH_SIGNALS, *v.MEDIUM_SIGNALS, *v.COMPLIANCE_SIGNALS,
]))


def _weighed(hits: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of phrases over all places where they occur: a place counts for its own phrase and for those that this begins with."""
    by_hit: dict[int, list[str]] = {}
    for hit in PHRASES:
        weight = sum(w for phrase, w in weights.items() if t.begins_with_phrase(hit, phrase))
        if weight:
            by_hit.setdefault(weight, []).append(hit)
    return sum((F.size(F.filter(hits, _one_of(own))) * weight for weight, own in by_hit.items()), F.lit(0))


def _one_of(phrases: list[str]):
    return lambda hit: hit.isin(*phrases)


def _has(hits: Column, phrase: str) -> Column:
    return F.exists(hits, _one_of([p for p in PHRASES if t.begins_with_phrase(p, phrase)]))


def scored(hits: Column, keywords: dict[str, tuple[str, ...]], long: int, own_name: int = 0) -> Column:
    """Names with a score, best first, equal ones in the vocabulary's order: hits count twice for keywords of over long characters."""
    entries = []
    for place, (name, words) in enumerate(keywords.items()):
        score = _weighed(hits, {w: 2 if len(w) > long else 1 for w in words})
        if own_name:
            score = score + F.when(_has(hits, name.lower()), own_name).otherwise(0)
        entries.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    return F.sort_array(F.filter(F.array(*entries), lambda e: e["score"] > 0), asc=False)


def signal_count(hits: Column, signals) -> Column:
    return _weighed(hits, dict.fromkeys(signals, 1))


def owner(sentence: Column, tags: Column) -> Column:
    """The first department whose name is part of the sentence, else the first with one of its five foremost keywords; else null."""
    low = F.lower(sentence)
    named = [F.when(F.contains(low, F.lit(d.lower())), d) for d in v.DEPARTMENTS]
    hinted = [F.when(t.has_phrase(tags, words[:5]), d) for d, words in v.DEPARTMENT_KEYWORDS.items()]
    return F.coalesce(*named, *hinted)


def with_body(df: DataFrame, filename: str = "filename", text: str = "extracted_text") -> DataFrame:
    """df with _raw (trimmed), _body (reflowed) and _hits (phrases found in file name and body, in one scan)."""
    df = df.withColumn("_raw", t.trimmed(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_body", t.reflow(F.col("_raw")))
    return df.withColumn("_hits", t.phrases_in(F.concat(F.col(filename), F.lit("\n"), F.col("_body")), PHRASES))


def with_department(df: DataFrame) -> DataFrame:
    df = df.withColumn("_departments", F.when(F.col("_body") != "", scored(F.col("_hits"), v.DEPARTMENT_KEYWORDS, 12)))
    df = df.withColumn("_top", F.coalesce(F.get("_departments", F.lit(0))["score"], F.lit(0)))
    ranked = F.coalesce(F.slice("_departments", 2, 3), F.expr("slice(_departments, 1, 0)"))
    second = F.transform(F.filter(ranked, lambda d: d["score"] >= F.greatest(F.lit(2.0), F.col("_top") * 0.35)), lambda d: d["name"])
    return df.withColumns({"department": F.coalesce(F.get("_departments", F.lit(0))["name"], F.lit(v.UNASSIGNED)), "secondary_departments": F.coalesce(second, F.array().cast("array<string>"))})


def document_type(hits: Column) -> Column:
    return F.coalesce(F.get(scored(hits, v.DOCUMENT_TYPE_KEYWORDS, 14, own_name=3), F.lit(0))["name"], F.lit("Other"))


def with_priority(df: DataFrame) -> DataFrame:
    """Needs the department."""
    df = df.withColumns({"_high": signal_count(F.col("_hits"), v.HIGH_SIGNALS), "_medium": signal_count(F.col("_hits"), v.MEDIUM_SIGNALS), "_dated": t.has_date(F.col("_body"))})
    high = (F.col("_high") >= 3) | ((F.col("_high") >= 1) & (F.col("department") == "Safety")) | ((F.col("_high") >= 2) & F.col("_dated"))
    medium = (F.col("_high") >= 1) | (F.col("_medium") >= 2) | F.col("_dated")
    return df.withColumn("priority", F.when(F.col("_body") == "", "Medium").when(high, "High").when(medium, "Medium").otherwise("Low"))


def with_terms(df: DataFrame) -> DataFrame:
    """df with _terms: the most frequent words of the body, equal ones by first place."""
    df = df.withColumn("_words", t.tokens(F.col("_body")))
    # Words in their order, each run of equal ones a match, beside all different words in the same order with their first places.
    runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array("_words"), "\n"), F.lit("\n")), F.lit(r"([^\n]+\n)\1*+"), F.lit(0))
    places = F.sort_array(F.transform(F.array_distinct("_words"), lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    ranked = F.zip_with(runs, places, lambda run, place: F.struct((-F.length(run) / (F.length(place["word"]) + 1)).cast("int").alias("less"), place["at"].alias("at"), place["word"].alias("word")))
    return df.withColumn("_terms", F.transform(F.slice(F.sort_array(ranked), 1, TERMS), lambda r: r["word"])).drop("_words")


def with_sentences(df: DataFrame) -> DataFrame:
    return df.withColumn("_sentences", F.transform(t.sentences(F.col("_body")), lambda s: F.struct(s.alias("s"), t.tagged(s).alias("tags"))))


def with_summary(df: DataFrame) -> DataFrame:
    """Needs terms and sentences."""
    calm = F.filter("_sentences", lambda x: t.upper_ratio(x["s"]) <= 0.6)
    df = df.withColumn("_calm", calm).withColumn("_candidates", F.slice(F.when(F.size("_calm") > 0, F.col("_calm")).otherwise(F.col("_sentences")), 1, MOST_CANDIDATES))

    def worth(x: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect(t.long_words(x["s"]), F.col("_terms")))
        return shared + F.when(t.has_phrase(x["tags"], v.ACTION_SIGNALS), 2).otherwise(0) + F.when(i < 5, 1.5).otherwise(0.0) - F.when(F.length(x["s"]) > 320, 0.5).otherwise(0.0)

    ranked = F.sort_array(F.transform("_candidates", lambda x, i: F.struct((-worth(x, i)).alias("less"), i.alias("at"), x["s"].alias("s"))))
    df = df.withColumn("_chosen", F.transform(F.sort_array(F.transform(F.slice(ranked, 1, SUMMARY_SENTENCES), lambda r: F.struct(r["at"], r["s"]))), lambda r: r["s"]))
    summary = t.once(t.trim_to(F.array_join("_chosen", " "), 900), lambda s: F.when(s != "", s))
    return df.withColumns({
        "summary": F.when(F.col("_body") == "", NO_TEXT).otherwise(F.coalesce(summary, F.left("_body", F.lit(400)))),
        "key_points": F.transform(F.slice("_chosen", 1, 4), lambda s: t.trim_to(s, 220)),
    }).drop("_calm", "_candidates", "_chosen")


def actions() -> Column:
    """Needs sentences, department and priority."""
    asking = F.slice(F.filter("_sentences", lambda x: t.has_phrase(x["tags"], v.ACTION_SIGNALS)), 1, 8)
    default = F.when(F.col("department") != v.UNASSIGNED, F.col("department")).otherwise("")
    return F.transform(asking, lambda x: F.struct(
        t.trim_to(x["s"], 260).alias("action"),
        F.coalesce(owner(x["s"], x["tags"]), default).alias("owner"),
        F.coalesce(t.first_date(x["s"]), F.lit("")).alias("due_date"),
        F.when(t.has_phrase(x["tags"], v.HIGH_SIGNALS), "High").otherwise(F.col("priority")).alias("priority"),
    ))


def deadlines() -> Column:
    """Sentences with a first date, one for each date, six at most."""
    dated = F.filter(F.transform("_sentences", lambda x: F.struct(t.first_date(x["s"]).alias("date"), x["s"].alias("s"))), lambda d: d["date"].isNotNull())
    none = F.array().cast("array<struct<date:string,s:string>>")
    first = F.aggregate(dated, none, lambda found, d: F.when((F.size(found) >= 6) | F.exists(found, lambda f: F.lower(f["date"]) == F.lower(d["date"])), found).otherwise(F.array_append(found, d)))
    return F.transform(first, lambda d: F.struct(d["date"].alias("date"), t.trim_to(d["s"], 200).alias("description")))


def risks() -> Column:
    return F.transform(F.slice(F.filter("_sentences", lambda x: t.has_phrase(x["tags"], v.RISK_SIGNALS)), 1, 5), lambda x: t.trim_to(x["s"], 200))


def flags(hits: Column) -> Column:
    found = F.array(*[F.when(_has(hits, s), s.title()) for s in sorted(v.COMPLIANCE_SIGNALS)])
    return F.slice(F.array_compact(found), 1, 6)


def with_title(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Each step is a column of its own, as it is used several times by the next."""
    df = df.withColumn("_line", t.title_line(F.col("_raw"))).withColumn("_cased", t.smart_cased(F.col("_line")))
    return df.withColumn("title", F.coalesce(F.when(F.col("_cased") != "", F.col("_cased")), t.title_from_filename(F.col(filename)))).drop("_line", "_cased")


def confidence(body: Column, top: Column) -> Column:
    """0.35 and up to 0.35 by length and 0.25 by the department's score, in hundredths."""
    parts = 1_680_000 + 420 * F.least(F.length(body), F.lit(4000)) + 100_000 * F.least(top, F.lit(12))
    return F.when(body == "", 0.15).otherwise(F.floor((parts + 24_000) / 48_000) / 100.0)


def analysed(df: DataFrame, filename: str = "filename", text: str = "extracted_text") -> DataFrame:
    """df with title, document_type, department, secondary_departments, priority, summary, key_points, keywords, actions, deadlines, risks, compliance_flags and analysis_confidence.

    A document without text is judged by its file name alone.
    """
    held = {"title", "document_type", "department", "secondary_departments", "priority", "summary", "key_points", "keywords", "actions", "deadlines", "risks", "compliance_flags", "analysis_confidence"}
    df = with_sentences(with_terms(with_priority(with_department(with_body(df.drop(*held), filename, text)))))
    df = with_summary(df).withColumns({"document_type": document_type(F.col("_hits")), "keywords": F.slice("_terms", 1, KEYWORDS)})
    empty = F.col("_body") == ""
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "actions": actions(), "deadlines": deadlines(), "risks": risks(),
        "compliance_flags": F.when(empty, none).otherwise(flags(F.col("_hits"))),
        "analysis_confidence": confidence(F.col("_body"), F.col("_top")),
    })
    df = with_title(df, filename)
    return df.drop(*[c for c in df.columns if c.startswith("_") and not c.startswith("__")])


def search_blob() -> Column:
    """All that search looks through, lower-cased, for rows of analysed() with a language column."""
    parts = [F.col(c) for c in ("filename", "title", "document_type", "department")]
    parts += [F.array_join("secondary_departments", " "), F.col("priority"), F.col("summary"), F.array_join("keywords", " "), F.array_join("key_points", " ")]
    parts += [F.array_join(F.transform("actions", lambda a: a["action"]), " "), F.col("language"), F.col("extracted_text")]
    return F.lower(F.concat_ws(" \n", *[F.when(p != "", p) for p in parts]))


def searchable(df: DataFrame) -> DataFrame:
    """Rows of analysed() with what a search over them reads: keywords_text, action_count, deadline_count and, if they have none, search_blob."""
    blob = {} if "search_blob" in df.columns else {"search_blob": search_blob()}
    counts = {f"{name}_count": F.greatest(F.size(f"{name}s"), F.lit(0)) for name in ("action", "deadline")}
    return df.withColumns({"keywords_text": t.json_list(F.col("keywords")), **blob, **counts})


_ENTRIES = {"actions": "action:string,owner:string,due_date:string,priority:string", "deadlines": "date:string,description:string"}
_LLM = f"title string, document_type string, department string, secondary_departments array<string>, priority string, summary string, key_points array<string>, keywords array<string>, actions array<struct<{_ENTRIES['actions']}>>, deadlines array<struct<{_ENTRIES['deadlines']}>>, risks array<string>, compliance_flags array<string>, confidence string"


def from_reply(reply: Column) -> dict[str, Column]:
    """Fields of a model's JSON reply, normalised and capped; what cannot be read gives defaults."""
    r = F.from_json(reply, F.lit(_LLM))
    strings = lambda c, n, low=False: F.slice(F.transform(F.coalesce(r[c], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) if low else F.trim(x)), 1, n)
    filled = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(r[c], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, n)
    clean = lambda x: F.coalesce(F.trim(x), F.lit(""))
    listed = lambda c: F.filter(F.coalesce(r[c], F.from_json(F.lit("[]"), f"array<struct<{_ENTRIES[c]}>>")), lambda x: x.isNotNull())
    second = F.filter(F.transform(F.coalesce(r["secondary_departments"], F.array().cast("array<string>")), v.normalise_department), lambda d: d != v.UNASSIGNED)
    asked = F.transform(F.filter(listed("actions"), lambda a: clean(a["action"]) != ""), lambda a: F.struct(clean(a["action"]).alias("action"), clean(a["owner"]).alias("owner"), clean(a["due_date"]).alias("due_date"), v.normalise_priority(a["priority"]).alias("priority")))
    due = F.transform(F.filter(listed("deadlines"), lambda d: clean(d["date"]) != ""), lambda d: F.struct(clean(d["date"]).alias("date"), clean(d["description"]).alias("description")))
    return {
        "title": t.trim_to(F.coalesce(r["title"], F.lit("")), 300), "document_type": v.normalise_document_type(r["document_type"]), "department": v.normalise_department(r["department"]),
        "secondary_departments": F.slice(second, 1, 4), "priority": v.normalise_priority(r["priority"]), "summary": clean(r["summary"]),
        "key_points": strings("key_points", 8), "keywords": strings("keywords", 15, low=True), "actions": F.slice(asked, 1, 12), "deadlines": F.slice(due, 1, 12),
        "risks": filled("risks", 8), "compliance_flags": filled("compliance_flags", 8), "confidence": as_confidence(r["confidence"]),
    }


def as_confidence(value: Column) -> Column:
    """Between 0 and 1 with two decimals, null if no number; what is not a number by its own word stays so."""
    number = value.try_cast("double")
    return F.when(F.isnan(number), number).when(number.isNotNull(), F.round(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), 2))


def readable(reply: Column) -> Column:
    """Whether a reply is a JSON object whose fields have the kinds that are read of them.

    Of names strings, of actions and deadlines lists of objects, of the other lists lists; null, false, 0 and
    what is empty stand for nothing everywhere.
    """
    whole = F.try_parse_json(reply)
    field = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    nothing = lambda x: x.isNull() | F.to_json(x).isin("null", "false", "0", '""', "{}", "[]")
    kind = F.schema_of_variant
    names = [nothing(x) | (kind(x) == "STRING") for x in map(field, ("document_type", "department", "priority"))]
    lists = [nothing(x) | kind(x).startswith("ARRAY<") for x in map(field, ("key_points", "keywords", "risks", "compliance_flags"))]
    second = field("secondary_departments")
    objects = [nothing(x) | kind(x).startswith("ARRAY<OBJECT<") for x in map(field, ("actions", "deadlines"))]
    sound = kind(whole).startswith("OBJECT<") & (nothing(second) | kind(second).isin("ARRAY<STRING>", "ARRAY<VOID>"))
    for part in (*names, *lists, *objects):
        sound = sound & part
    return F.coalesce(sound, F.lit(False))


def with_fallback(df: DataFrame, reply: str, error: str, filename: str = "filename", text: str = "extracted_text") -> DataFrame:
    """The fields of a model's reply where there is a readable() one, of analysed() elsewhere, and analysis_engine and analysis_error.

    reply is a column of JSON, null where the model was not asked or failed; error
    says how it failed. A document without text is left to the rules. Texts with a reply are not looked at by them; a title that a reply lacks is the file name's.
    """
    given = from_reply(F.col(reply))
    asked = t.trimmed(F.coalesce(F.col(text), F.lit(""))) != ""
    failed = asked & ~F.col("__read") & (F.col(reply).isNotNull() | F.col(error).isNotNull())
    df = df.withColumn("__read", asked & readable(F.col(reply))).withColumn("__failed", F.coalesce(failed, F.lit(False)))
    df = df.withColumn("__text", F.col(text)).withColumn(text, F.when(~F.col("__read"), F.col(text)))
    df = analysed(df, filename, text).withColumn(text, F.col("__text"))
    fields = {name: F.when(F.col("__read"), column).otherwise(F.col(name)) for name, column in given.items() if name not in ("confidence", "title")}
    fields["title"] = F.when(F.col("__read") & (given["title"] != ""), given["title"]).otherwise(F.col("title"))
    fields["analysis_confidence"] = F.when(F.col("__read"), given["confidence"]).otherwise(F.col("analysis_confidence"))
    fields["analysis_engine"] = F.when(F.col("__read"), "model").otherwise("rule-based")
    note = F.concat(F.lit("AI analysis unavailable ("), F.coalesce(F.col(error), F.lit("unreadable reply")), F.lit("); used rule-based analysis."))
    fields["analysis_error"] = F.when(F.col("__failed"), note).otherwise("")
    return df.withColumns(fields).drop("__read", "__failed", "__text")
