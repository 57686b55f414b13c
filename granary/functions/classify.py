"""Classification by a lexicon and pattern votes, with a verdict that can say "don't know"."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import patterns as pat
from granary.functions import people as who
from granary.session import materialize

#: Least score and share of a verdict, score below which a model would be asked, weights, caps.
MIN_SCORE, MIN_SHARE, ESCALATE_BELOW = 6.0, 0.34, 14.0
STRONG, TERM, CUE, EXT, TERM_CAP = 3.0, 1.0, 4.0, 6.0, 4

#: The built-in vocabulary; callers may pass their own in the same form. Axis -> category -> (strong terms, terms, name cues, extensions).
VOCABULARY: Mapping[str, Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str], Sequence[str]]]] = {
    "doctype": {
        "invoice": (["invoice number", "invoice no", "amount due", "total due", "balance due", "remit to", "payment terms", "net 30", "bill to"], ["invoice", "subtotal", "vat", "gst", "purchase order", "po number", "due date", "quantity", "unit price"], ["invoice", "inv-", "inv_", "bill"], []),
        "receipt": (["thank you for your purchase", "order confirmation", "transaction id", "card ending", "change due", "cashier"], ["receipt", "order number", "merchant", "refund", "subtotal", "tendered", "auth code"], ["receipt", "order"], []),
        "statement": (["account summary", "closing balance", "opening balance", "statement period", "available credit", "minimum payment"], ["statement", "account number", "deposits", "withdrawals", "interest", "transactions", "sort code", "iban"], ["statement", "stmt"], []),
        "contract": (["hereinafter", "whereas", "in witness whereof", "governing law", "the parties agree", "shall be deemed", "indemnify", "termination for convenience", "entire agreement"], ["agreement", "contract", "clause", "parties", "liability", "confidentiality", "warranty", "jurisdiction", "effective date", "executed"], ["contract", "agreement", "nda", "msa", "sow", "terms"], []),
        "report": (["executive summary", "key findings", "recommendations", "table of contents", "appendix", "methodology"], ["report", "analysis", "overview", "summary", "conclusion", "quarter", "annual", "performance", "metrics", "kpi"], ["report", "review", "analysis", "q1", "q2", "q3", "q4"], []),
        "presentation": (["agenda slide", "thank you questions", "next steps", "our mission", "key takeaways"], ["slide", "agenda", "roadmap", "vision", "takeaway", "appendix"], ["deck", "slides", "presentation", "pitch", "kickoff", "all hands", "allhands", "townhall"], ["pptx", "ppt", "key", "odp"]),
        "spreadsheet": ([], ["total", "sum", "row", "column", "sheet", "average"], ["sheet", "table", "export", "tracker"], ["xlsx", "xls", "csv", "tsv", "ods"]),
        "log": (["stack trace", "exception in thread", "connection refused", "segmentation fault", "traceback"], ["error", "warn", "warning", "info", "debug", "trace", "fatal", "exception", "timeout", "retry", "request", "response", "status"], ["log", "logs", "syslog", "stderr", "stdout", "crash", "dump", "trace"], ["log"]),
        "source-code": (["public static void", "def", "function", "#include", "import", "class", "const", "namespace"], ["var", "let", "null", "true", "false", "async", "await", "self", "params", "endpoint", "return"], [".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".rb", ".cs", ".sh", ".sql"], ["py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "c", "h", "cpp", "rb", "cs", "sh", "ps1", "sql", "json", "yaml", "yml", "toml"]),
        "resume": (["curriculum vitae", "work experience", "professional experience", "references available", "career objective", "employment history"], ["resume", "education", "skills", "certifications", "achievements", "responsibilities", "bachelor", "master", "graduated"], ["resume", "cv", "curriculum"], []),
        "letter": (["dear sir", "dear madam", "yours sincerely", "yours faithfully", "kind regards", "to whom it may concern", "best regards"], ["dear", "sincerely", "regards", "enclosed", "writing to"], ["letter", "cover", "memo"], []),
        "meeting-notes": (["action items", "attendees", "minutes of the meeting", "apologies for absence", "follow up items", "decisions made"], ["meeting", "agenda", "notes", "discussion", "owner", "standup", "retro", "retrospective"], ["notes", "minutes", "meeting", "standup", "retro"], []),
        "form": (["please complete", "for office use only", "signature date", "tick as appropriate", "check all that apply"], ["form", "applicant", "please print", "required", "surname", "date of birth"], ["form", "application", "questionnaire", "survey"], []),
        "paper": (["abstract", "et al", "literature review", "we propose", "related work", "future work", "doi"], ["hypothesis", "methodology", "experiment", "dataset", "results", "citation", "references", "journal", "arxiv"], ["paper", "thesis", "dissertation", "arxiv", "preprint"], []),
        "manual": (["getting started", "troubleshooting", "before you begin", "safety instructions", "step by step"], ["manual", "guide", "instructions", "installation", "setup", "configuration", "requirements", "caution", "chapter"], ["manual", "guide", "handbook", "readme", "howto", "docs"], []),
        "policy": (["this policy applies", "scope and purpose", "code of conduct", "acceptable use", "compliance with"], ["policy", "procedure", "guideline", "mandatory", "compliance", "governance", "retention"], ["policy", "procedure", "compliance"], []),
        "proposal": (["statement of work", "scope of work", "deliverables", "proposed approach", "timeline and milestones"], ["proposal", "quotation", "estimate", "tender", "scope", "assumptions", "milestone"], ["proposal", "quote", "rfp", "estimate"], []),
        "transcript": (["speaker 1", "speaker 2", "inaudible", "crosstalk"], ["transcript", "interview", "recording", "verbatim", "timestamp"], ["transcript", "interview", "recording"], ["srt", "vtt"]),
        "screenshot": ([], [], ["screenshot", "screen shot", "screen_shot", "snip", "capture"], []),
        "photo": ([], [], ["photo", "pic", "img"], []),
        "recording": ([], [], ["recording", "audio", "video"], []),
        "certificate": (["this certifies that", "hereby certifies", "certificate of"], ["certificate", "certification", "awarded", "valid until", "credential", "diploma"], ["certificate", "cert", "diploma", "licence", "license"], []),
    },
    "topic": {
        "finance": (["balance sheet", "income statement", "cash flow", "ebitda", "gross margin", "profit and loss", "accounts payable", "accounts receivable", "fiscal year", "amount due"], ["invoice", "revenue", "expense", "budget", "forecast", "cost", "payment", "tax", "vat", "ledger", "transaction", "interest", "capital", "depreciation", "opex", "capex", "variance", "margin", "valuation", "funding", "payroll"], ["finance", "budget", "invoice", "expense", "payroll", "accounts", "tax"], []),
        "legal": (["governing law", "hereinafter", "in witness whereof", "intellectual property", "limitation of liability", "force majeure", "dispute resolution"], ["agreement", "contract", "clause", "liability", "warranty", "indemnity", "litigation", "counsel", "statute", "regulation", "jurisdiction", "plaintiff", "defendant", "trademark", "copyright", "patent"], ["legal", "contract", "nda", "agreement", "terms"], []),
        "hr": (["employment agreement", "performance review", "notice period", "annual leave", "probation period", "onboarding"], ["employee", "candidate", "recruiter", "salary", "benefits", "sick leave", "appraisal", "promotion", "headcount", "hiring", "resignation", "offer letter"], ["hr", "people", "hiring", "recruit", "onboarding", "resume", "cv"], []),
        "engineering": (["pull request", "unit test", "stack trace", "api endpoint", "database schema", "deployment pipeline", "root cause"], ["server", "client", "api", "database", "query", "latency", "throughput", "deploy", "release", "commit", "branch", "container", "kubernetes", "docker", "repository", "refactor", "architecture", "endpoint", "schema", "cache"], ["eng", "dev", "build", "deploy", "api", "src", "code", "architecture"], []),
        "marketing": (["brand guidelines", "target audience", "conversion rate", "go to market", "customer journey", "campaign performance"], ["campaign", "brand", "audience", "impressions", "engagement", "ctr", "seo", "newsletter", "creative", "messaging", "positioning", "funnel", "awareness"], ["marketing", "campaign", "brand", "social", "content"], []),
        "sales": (["pipeline review", "closed won", "closed lost", "renewal date", "deal desk"], ["prospect", "opportunity", "pipeline", "quota", "deal", "discount", "renewal", "churn", "upsell", "crm"], ["sales", "pipeline", "deals", "crm"], []),
        "research": (["literature review", "we hypothesise", "we hypothesize", "statistically significant", "control group", "peer review"], ["study", "experiment", "hypothesis", "sample", "dataset", "correlation", "variable", "methodology", "survey", "findings", "citation", "journal", "abstract"], ["research", "study", "paper", "thesis", "experiment"], []),
        "medical": (["patient name", "medical history", "treatment plan", "diagnosis", "prescribed", "icd 10"], ["patient", "clinic", "hospital", "symptoms", "dosage", "prescription", "referral", "consultant", "vaccination", "allergy"], ["medical", "health", "patient", "clinic", "prescription"], []),
        "education": (["learning outcomes", "course syllabus", "assignment brief", "marking criteria"], ["course", "lecture", "student", "assignment", "exam", "grade", "module", "syllabus", "curriculum", "homework", "tutor", "university", "coursework"], ["course", "lecture", "class", "school", "university", "assignment", "exam"], []),
        "operations": (["standard operating procedure", "service level agreement", "incident report", "supply chain", "inventory count"], ["workflow", "logistics", "inventory", "supplier", "vendor", "shipment", "warehouse", "capacity", "maintenance", "sop", "sla", "downtime"], ["ops", "operations", "logistics", "inventory", "vendor", "supplier"], []),
        "security": (["access control", "threat model", "penetration test", "security incident", "multi factor", "least privilege"], ["password", "credential", "token", "encryption", "vulnerability", "exploit", "firewall", "breach", "phishing", "malware", "permission", "mfa", "cve"], ["security", "secrets", "keys", "credentials", "vault"], []),
        "personal": (["happy birthday", "see you soon", "family photo"], ["family", "birthday", "wedding", "friends", "recipe", "hobby", "shopping", "diary", "journal"], ["personal", "family", "diary", "birthday", "wedding"], []),
        "travel": (["boarding pass", "flight number", "check in time", "booking reference", "departure gate", "itinerary"], ["flight", "hotel", "booking", "reservation", "passport", "visa", "airport", "departure", "arrival", "baggage", "destination"], ["travel", "trip", "flight", "hotel", "booking", "itinerary", "holiday", "vacation"], []),
        "design": (["design system", "style guide", "wireframe", "user flow", "colour palette", "color palette"], ["mockup", "prototype", "layout", "typography", "palette", "icon", "spacing", "component", "accessibility"], ["design", "mockup", "wireframe", "figma", "assets"], []),
    },
}


#: Names that are shown otherwise than with spaces and a capital, and tag confidences by the source of an author.
DISPLAYS = {"resume": "CV / Resume", "hr": "People & HR"}
AUTHOR_CONFIDENCE = {"metadata": 0.95, "id3": 0.95, "signature": 0.8, "byline": 0.8, "filename": 0.6, "email": 0.5}
#: Confidences of other tags, how many of each a verdict gives, and the length of its reasoning.
TOPIC_TOO, YEAR, PATTERN, ENTITY, PERSON = 0.4, 0.9, 1.0, 0.7, 0.6
MORE_TOPICS, YEARS, ENTITIES, REASONS, REASONING = 3, 6, 8, 3, 500


def display(name) -> Column:
    """A category as it is shown."""
    shown = F.concat(F.upper(F.left(name, F.lit(1))), F.replace(F.substr(name, F.lit(2)), F.lit("-"), F.lit(" ")))
    for k, v in DISPLAYS.items():
        shown = F.when(name == k, v).otherwise(shown)
    return shown


def reasoning(doctype: Column, topic: Column, hits: Column, author_source: Column, kind: Column) -> Column:
    """One line: the verdict on both axes, what the three most frequent patterns found (ties in order of the detectors), where the author is from."""
    a, b = display(doctype), F.lower(display(topic))
    head = F.coalesce(F.concat(a, F.lit(" ("), b, F.lit(")")), a, b, F.lit("no confident classification"))
    notes = F.create_map(*[F.lit(x) for kv in pat.NOTES.items() for x in kv])
    ranked = F.array_sort(F.transform(hits, lambda h, i: F.struct((-h["n"]).alias("n"), i.alias("i"), F.try_element_at(notes, h["name"]).alias("note"))))
    said = F.slice(F.transform(F.filter(ranked, lambda x: x["note"].isNotNull()), lambda x: x["note"]), 1, REASONS)
    by = F.when(author_source.isNotNull(), F.array(F.concat(F.lit("author from "), author_source))).otherwise(F.array().cast("array<string>"))
    why = F.array_join(F.concat(said, by), "; ")
    return F.left(F.concat(head, F.lit(" -- "), F.when(why != "", why).otherwise(F.concat(F.coalesce(kind, F.lit("")), F.lit(" with no distinctive content")))), F.lit(REASONING))


def lexicon(spark, vocabulary=VOCABULARY) -> DataFrame:
    """(axis, category, place, kind, term, weight): bounded by the vocabulary that the caller gives."""
    rows = []
    for axis, cats in vocabulary.items():
        for place, (cat, (strong, terms, cues, exts)) in enumerate(cats.items()):
            for kind, weight, names in (("term", STRONG, strong), ("term", TERM, terms), ("cue", CUE, cues), ("ext", EXT, exts)):
                rows += [(axis, cat, place, kind, t.lower(), weight) for t in names]
    return spark.createDataFrame(rows, "axis string, category string, place int, kind string, term string, weight double")


def lexicon_scores(docs: DataFrame, lex: DataFrame, *, key: str = "file_id", longest: int = 5, scan: int | None = None) -> DataFrame:
    """(key, axis, category, place, score) of docs(key, name, ext, text).

    Only words that are the heads of terms become rows, with the words behind them, up to
    ``longest``, which are put together and compared with the broadcast vocabulary. Other
    characters are tokens of their own, so only white space may stand inside a term; the few
    terms with other characters are counted as they stand. Whole texts count, or their first ``scan`` characters.
    """
    low = F.lower(pat.scanned(F.col("text"), scan))
    toks = F.regexp_extract_all(low, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))
    w = [f"w{i}" for i in range(1, longest + 1)]
    plain = F.col("term").rlike(r"(?U)^[\w\s]*$")
    terms = lex.filter("kind = 'term'").select("term", "axis", "category", "place", "weight")
    words = F.split("term", r"\s+")
    heads = F.broadcast(terms.filter(plain).withColumn("n", F.size(words)).withColumn("w1", F.get(words, F.lit(0))))
    first = [r["w1"] for r in terms.filter(plain).select(F.get(words, F.lit(0)).alias("w1")).distinct().collect()]  # words of the vocabulary, which is broadcast too
    at = F.filter(F.transform("t", lambda x, i: F.when(x.isin(first), i)), lambda i: i.isNotNull())
    ahead = F.transform(at, lambda i: F.slice("t", i + 1, longest))
    runs = docs.select(key, toks.alias("t")).select(key, F.explode(ahead).alias("a")).select(key, *[F.get("a", F.lit(i)).alias(x) for i, x in enumerate(w)])
    whole = F.element_at(F.array(*[F.concat_ws(" ", *w[:n]) for n in range(1, longest + 1)]), F.least("n", F.lit(longest)))
    found = runs.join(heads, "w1").filter((F.col("n") <= longest) & (F.get(F.array(*w), F.col("n") - 1).isNotNull()) & (whole == F.col("term")))
    hit = found.groupBy(key, "axis", "category", "place", "term", "weight").agg(F.count("*").alias("n"))
    odd = docs.select(key, low.alias("low")).crossJoin(F.broadcast(terms.filter(~plain)))
    n = F.regexp_count("low", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("term"), F.lit(r"\E(?!\w)"))).cast("long")
    odd = odd.filter(F.contains("low", "term"))  # a search for bytes, before a pattern is compiled
    hit = hit.unionByName(odd.withColumn("n", n).filter("n > 0").drop("low"))
    words = hit.select(key, "axis", "category", "place", (F.col("weight") * F.least("n", F.lit(TERM_CAP))).alias("score"))
    cues = docs.select(key, F.lower("name").alias("name")).join(F.broadcast(lex.filter("kind = 'cue'")), F.contains(F.col("name"), F.col("term"))).select(key, "axis", "category", "place", F.col("weight").alias("score"))
    exts = docs.select(key, F.lower("ext").alias("term")).join(F.broadcast(lex.filter("kind = 'ext'")), "term").select(key, "axis", "category", "place", F.col("weight").alias("score"))
    return words.unionByName(cues).unionByName(exts).groupBy(key, "axis", "category", "place").agg(F.sum("score").alias("score"))


def votes(found: DataFrame, *, key: str = "file_id") -> DataFrame:
    """(key, axis, category, place, score) from fired patterns (key, hits)."""
    rows = [(d.name, axis, vote[0], vote[1], d.cap, i) for i, d in enumerate(pat.DETECTORS) for axis, vote in (("doctype", d.doctype), ("topic", d.topic)) if vote]
    table = found.sparkSession.createDataFrame(rows, "name string, axis string, category string, weight double, cap int, place int")
    h = found.select(key, F.explode("hits").alias("h")).select(key, "h.name", "h.n").join(F.broadcast(table), "name")
    return h.groupBy(key, "axis", "category").agg(F.sum(F.col("weight") * F.least("n", "cap")).alias("score"), (F.min("place") + 1000).cast("int").alias("place")).select(key, "axis", "category", "place", "score")


def decide(scores: DataFrame, *, key: str = "file_id", min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, axis, label, score, others): the best category if it is strong enough on its own and among the rest.

    The score stays where the label is null. Ties go to the lexicon's better category, then to
    vocabulary order, then to categories that only patterns named. ``others`` has up to four more that are strong.
    """
    lexical = F.max(F.when(F.col("place") < 1000, F.col("score")).otherwise(0.0)).alias("lexical")
    s = scores.groupBy(key, "axis", "category").agg(F.sum("score").alias("score"), lexical, F.min("place").alias("place")).filter("score > 0")
    w = Window.partitionBy(key, "axis")
    s = s.withColumn("total", F.sum("score").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), F.desc("lexical"), "place")))
    top = F.max(F.when(F.col("k") == 1, F.struct("category", "score", "total"))).alias("top")
    rest = F.sort_array(F.collect_list(F.when((F.col("k") > 1) & (F.col("score") >= min_score), F.struct("k", "category")))).alias("rest")
    g = s.groupBy(key, "axis").agg(top, rest)
    good = (F.col("top.score") >= min_score) & (F.col("top.score") / F.col("top.total") >= min_share)
    return g.select(key, "axis", F.when(good, F.col("top.category")).alias("label"), F.round("top.score", 2).alias("score"), F.slice(F.transform("rest", lambda x: x["category"]), 1, 4).alias("others"))


def inspect(docs: DataFrame, vocabulary=VOCABULARY, *, key: str = "file_id") -> DataFrame:
    """One verdict per document of docs(key, name, rel_path, ext, media_type, text, meta map, captured_at, created_at, modified_at)."""
    text = F.col("text")
    found = docs.select(key, "name", "ext", "media_type", "meta", "captured_at", "created_at", "modified_at", pat.hits(text, F.col("name")).alias("hits"), pat.dates(text).alias("dates"), who.people(text).alias("people"), who.organisations(text).alias("entities"))
    found = materialize(found, "verdict-evidence")  # without texts, which are read for it once and for the vocabulary once
    scores = lexicon_scores(docs, lexicon(docs.sparkSession, vocabulary), key=key).unionByName(votes(found, key=key))
    on = lambda a: F.max(F.when(F.col("axis") == a, F.struct(F.col("label").alias(a), F.col("score").alias(f"{a}_score"), F.col("others").alias(f"{a}_others")))).alias(a)
    labels = decide(scores, key=key).groupBy(key).agg(on("doctype"), on("topic")).select(key, "doctype.*", "topic.*")
    fallback = F.when(F.col("media_type") == "image", "photo").when(F.col("media_type").isin("video", "audio"), "recording")
    event = pat.event_date(F.col("dates"), F.col("captured_at"), F.col("created_at"), F.col("name"), F.col("modified_at"))
    by = who.author(F.col("meta"), F.col("name"), F.col("people"))
    out = found.join(labels, key, "left").withColumn("event", event).withColumn("by", by)
    doctype = F.coalesce("doctype", fallback)
    return out.select(
        key, doctype.alias("doctype"), F.coalesce("doctype_score", F.when(doctype.isNotNull(), MIN_SCORE).otherwise(0.0)).alias("doctype_score"), "topic", F.coalesce("topic_score", F.lit(0.0)).alias("topic_score"), "topic_others",
        F.col("by.name").alias("author"), F.col("by.source").alias("author_source"), F.col("event.at").alias("event_at"), F.col("event.source").alias("event_source"), pat.years(F.col("dates"), F.col("event.at")).alias("years"),
        "entities", F.transform("hits", lambda h: h["name"]).alias("patterns"), "hits", (doctype.isNull() | (F.coalesce("topic_score", F.lit(0.0)) < ESCALATE_BELOW)).alias("escalate"),
        reasoning(doctype, F.col("topic"), F.col("hits"), F.col("by.source"), F.coalesce(F.nullif(F.lower("ext"), F.lit("")), "media_type")).alias("reasoning"), F.transform("people", lambda p: p["name"]).alias("people"),
    )


def findings_to_tags(found: DataFrame, *, key: str = "file_id") -> DataFrame:
    """(key, kind, name, confidence) that a verdict gives: its labels, further topics, author, years, patterns, organisations and people."""
    sure = lambda c: F.round(F.least(F.lit(1.0), F.lit(0.4) + F.col(c) / 60), 3)
    t = lambda kind, name, conf: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), conf.alias("confidence"))
    none = F.array().cast("array<string>")
    each = lambda kind, names, n, conf: F.transform(F.slice(F.coalesce(names, none), 1, n), lambda x: t(kind, x, F.lit(conf)))
    by = F.create_map(*[F.lit(x) for kv in AUTHOR_CONFIDENCE.items() for x in kv])
    one = F.array(t("doctype", F.col("doctype"), sure("doctype_score")), t("topic", F.col("topic"), sure("topic_score")), t("author", F.col("author"), F.coalesce(F.try_element_at(by, F.col("author_source")), F.lit(0.5))))
    # the first eight count before the author is left out, who has a tag already
    others = F.filter(each("entity", F.col("people"), ENTITIES, PERSON), lambda x: ~F.coalesce(x["name"] == F.col("author"), F.lit(False)))
    many = F.concat(
        one, each("topic", F.col("topic_others"), MORE_TOPICS, TOPIC_TOO), each("date", F.transform("years", lambda y: y.cast("string")), YEARS, YEAR), F.transform(F.coalesce("patterns", none), lambda x: t("pattern", x, F.lit(PATTERN))), each("entity", F.col("entities"), ENTITIES, ENTITY), others
    )
    return found.select(key, F.explode(many).alias("t")).filter("t.name IS NOT NULL").select(key, "t.kind", "t.name", "t.confidence")


def closed_vocabulary(answer, names: Sequence[str], synonyms: Mapping[str, str] | None = None):
    """A free answer as a name of a closed vocabulary, by itself, a synonym, hyphens, or a unique prefix of five letters; else null."""
    a = F.regexp_replace(F.lower(F.trim(answer)), r"[\s_]+", "-")
    out = F.when(a.isin(list(names)), a)
    for k, v in (synonyms or {}).items():
        out = out.when(a == k.lower().replace(" ", "-"), v)
    short = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.startswith(n, F.substring(a, 1, 5)))
    return out.when((F.length(a) >= 5) & (F.size(short) == 1), F.get(short, F.lit(0)))


#: How much of a model's answer is taken.
MOST_EXTRA, MOST_OBJECTS, OBJECT_CHARS, DESCRIPTION_CHARS = 3, 8, 60, 300


def merge_answer(verdicts: DataFrame, answers: DataFrame, *, key: str = "file_id", source: str = "model") -> DataFrame:
    """Verdicts after a model's answers (key, doctype, topics array, objects array, description), matched to the vocabulary already.

    An answer fills gaps and replaces what scored too low, never a sure rule: the doctype below
    MIN_SCORE, the topic below ESCALATE_BELOW. Further topics and objects are added if they are
    new. Verdicts without an answer stay as they are.
    """
    a = answers.select(key, F.lit(True).alias("_asked"), F.col("doctype").alias("_doctype"), F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("_topics"), F.coalesce("objects", F.array().cast("array<string>")).alias("_objects"), F.col("description").alias("_said"))
    v = verdicts.join(a, key, "left")
    asked = F.coalesce("_asked", F.lit(False))
    new_kind = asked & F.col("_doctype").isNotNull() & (F.col("doctype").isNull() | (F.col("doctype_score") < MIN_SCORE))
    first = F.get("_topics", F.lit(0))
    new_topic = asked & first.isNotNull() & (F.col("topic").isNull() | (F.col("topic_score") < ESCALATE_BELOW))
    v = v.withColumns({"doctype": F.when(new_kind, F.col("_doctype")).otherwise(F.col("doctype")), "doctype_score": F.when(new_kind, F.greatest("doctype_score", F.lit(MIN_SCORE))).otherwise(F.col("doctype_score"))})
    v = v.withColumns({"_topic": F.when(new_topic, first).otherwise(F.col("topic")), "topic_score": F.when(new_topic, F.greatest("topic_score", F.lit(MIN_SCORE))).otherwise(F.col("topic_score"))})
    none = F.array().cast("array<string>")
    extra = F.filter(F.slice("_topics", 2, MOST_EXTRA), lambda t: ~t.eqNullSafe(F.col("_topic")))
    seen = F.transform(F.coalesce("entities", none), lambda e: F.lower(e))
    clean = F.transform(F.slice("_objects", 1, MOST_OBJECTS), lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, OBJECT_CHARS))
    found = F.filter(clean, lambda x: (x != "") & ~F.array_contains(seen, F.lower(x)))
    once = F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: F.lower(y) == F.lower(x)))
    said = F.concat(F.substring(F.trim("_said"), 1, DESCRIPTION_CHARS), F.lit(" (model)"))
    return v.withColumns({
        "topic": F.col("_topic"), "topic_others": F.when(asked, F.array_distinct(F.concat(F.coalesce("topic_others", none), extra))).otherwise(F.col("topic_others")), "entities": F.when(asked, F.concat(F.coalesce("entities", none), once)).otherwise(F.col("entities")),
        "reasoning": F.when(asked & (F.coalesce(F.trim("_said"), F.lit("")) != ""), said).otherwise(F.col("reasoning")), "escalate": asked | F.col("escalate"), "decided_by": F.when(asked, F.lit(source)).otherwise(F.lit("rules")),
    }).drop("_asked", "_doctype", "_topics", "_topic", "_objects", "_said")


def evidence(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files (asset_id, rel_path, …) with what a verdict reads: their texts in one, and the last two folders.

    A document's own text comes before what was read off pictures or written by a model.
    """
    late = F.col("source").rlike("^(ai_|image_ocr|pdf_ocr)")
    text = blocks.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), F.coalesce("ord", F.lit(0)).alias("ord"), "source", "body"))).alias("parts"))
    text = text.select("asset_id", F.array_join(F.transform("parts", lambda x: x["body"]), "\n").alias("text"))
    folders = F.split(F.regexp_replace("rel_path", r"/?[^/]*$", ""), "/")
    last = F.array_join(F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), 2), "/")
    return files.join(text, "asset_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rel_path", last)
