"""Résumé documents as tables: sections, prompts, assembly, section status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import is_blank, strip
from sheaf.session import materialise

TURNS = 4  # in which résumés are put together
STATUSES = ("Not Started", "In Progress", "Completed", "Failed")


@dataclass(frozen=True)
class Section:
    """A part of a résumé: its header, the header after it, the prompt for it if it is tailored."""

    name: str
    header: str | None = None
    until: str | None = None
    prompt: str | None = None
    label: str | None = None


# Order, headers and prompt texts.
SECTIONS = (
    Section("header"),
    Section(
        "summary",
        "Resume Summary",
        "CAREER HIGHLIGHTS",
        "You are a professional resume writer. Tailor the resume summary below for the job description provided. Keep it 3–5 sentences, "
        "impact-focused, and specific to the role. Return only the summary text with no markdown headers.",
        "SUMMARY",
    ),
    Section(
        "highlights",
        "CAREER HIGHLIGHTS",
        "CORE COMPETENCIES",
        "You are a professional resume writer. From the career highlights below, select and refine the 5–7 most relevant bullet points for the "
        "job description. Keep each point quantified and impactful. Return only bullet points.",
        "HIGHLIGHTS",
    ),
    Section(
        "competencies",
        "CORE COMPETENCIES",
        "AWARDS & RECOGNITION",
        "You are a professional resume writer. Tailor the core competencies below to best align with the job description. Prioritize relevant "
        "skills; reorder or trim as needed. Return only the competencies content with no top-level header.",
        "COMPETENCIES",
    ),
    Section("awards", "AWARDS & RECOGNITION", "WORK EXPERIENCE"),
    Section(
        "experience",
        "WORK EXPERIENCE",
        "CERTIFICATION/TRAINING",
        "You are a professional resume writer. Tailor the work experience below for the job description. Retain all roles but prioritize and "
        "refine bullet points that are most relevant. Use strong action verbs and preserve quantified achievements. "
        "Return the formatted experience section without a top-level header.",
        "EXPERIENCE",
    ),
    Section("certifications", "CERTIFICATION/TRAINING", "EDUCATION"),
    Section("education", "EDUCATION"),
)


def section(body: Column, header: str, until: str | None) -> Column:
    """Text from ``# header`` up to ``# until``, trimmed; '' without the header."""
    start = F.locate(f"# {header}", body)
    rest = F.substring(body, start, F.length(body))
    if until is not None:
        end = F.position(F.lit(f"# {until}"), body, F.greatest(start, F.lit(1)))
        rest = F.when(end > 0, F.substring(body, start, end - start)).otherwise(rest)
    return F.when(start > 0, strip(rest)).otherwise(F.lit(""))


def preamble(body: Column) -> Column:
    """Text before the first section; the whole text when there is none."""
    first = F.locate("\n# ", body)
    return strip(F.when(first > 0, F.substring(body, F.lit(1), first - 1)).otherwise(body))


def section_rows(resumes: DataFrame, sections: tuple[Section, ...] = SECTIONS) -> DataFrame:
    """``(resume_id, ord, section, body)``: each section of each résumé."""
    body = F.col("body")
    parts = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(s.name).alias("section"),
            (preamble(body) if s.header is None else section(body, s.header, s.until)).alias("body"),
        )
        for i, s in enumerate(sections)
    ]
    return resumes.select("resume_id", F.explode(F.array(*parts)).alias("p")).select("resume_id", "p.*")


def prompt_rows(
    resumes: DataFrame,
    jobs: DataFrame,
    pairs: DataFrame | None = None,
    sections: tuple[Section, ...] = SECTIONS,
) -> DataFrame:
    """``(prompt_id, resume_id, job_id, section, ord, prompt)`` for the tailored sections.

    ``jobs(job_id, job_description)``; ``pairs(resume_id, job_id)`` says which job is
    tailored for which résumé. Without pairs there must be one résumé, which
    then goes with every job.
    """
    tailored = [s for s in sections if s.prompt]
    body = F.col("body")
    usable = jobs.where(F.col("job_description") != "")
    if pairs is None:
        if len(resumes.take(2)) > 1:
            raise ValueError("name the (resume_id, job_id) pairs when there are several résumés")
        joined = usable.join(F.broadcast(resumes.select("resume_id", "body")))
    else:
        joined = pairs.join(resumes.select("resume_id", "body"), "resume_id").join(usable, "job_id")
    parts = [
        F.struct(
            F.lit(sections.index(s)).alias("ord"),
            F.lit(s.name).alias("section"),
            F.concat(
                F.lit(f"{s.prompt}\n\nORIGINAL {s.label}:\n"),
                section(body, s.header, s.until),
                F.lit("\n\nJOB DESCRIPTION:\n"),
                F.col("job_description"),
            ).alias("prompt"),
        )
        for s in tailored
    ]
    rows = joined.select("resume_id", "job_id", F.explode(F.array(*parts)).alias("p")).select(
        "resume_id", "job_id", "p.*"
    )
    key = F.concat_ws("/", F.col("resume_id").cast("string"), F.col("job_id").cast("string"), "section")
    return usable_prompts(rows.withColumn("prompt_id", key))


def usable_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.where(~is_blank(F.col("prompt")))


# Fixed value: the prompt for the contact header.
HEADER_PROMPT = """\
You are a professional resume writer. Extract only the contact header from the resume text below.

Include ONLY:
- Candidate full name (first line)
- Email address
- Phone number
- Professional web links (LinkedIn, GitHub, portfolio, etc.)

Do NOT include:
- Degrees, diplomas, or any educational history
- Institutions, universities, or schools
- Dates or years of any kind
- Summaries, titles, or any other content

Return the header as plain text only. No markdown. No labels like "Email:" unless present in the resume.

RESUME TEXT:
{resume}

Omit any field not found in the resume. Return an empty string if nothing relevant is found."""


def header_prompts(resumes: DataFrame) -> DataFrame:
    """``(resume_id, prompt)`` asking for the contact header."""
    before, after = HEADER_PROMPT.split("{resume}")
    return usable_prompts(
        resumes.select("resume_id", F.concat(F.lit(before), F.col("body"), F.lit(after)).alias("prompt"))
    )


def assemble(
    resumes: DataFrame,
    prompts: DataFrame,
    responses: DataFrame,
    sections: tuple[Section, ...] = SECTIONS,
) -> DataFrame:
    """``(resume_id, job_id, resume)``: fixed parts as they are, tailored ones from ``responses(prompt_id, response)``.

    Every résumé has the same few sections, so a group never grows with the data.
    """
    asked = prompts.select("prompt_id", "resume_id", "job_id", "ord")
    names = F.create_map(*[F.lit(x) for i, s in enumerate(sections) for x in (i, s.name)])
    own = F.concat_ws("/", F.col("resume_id").cast("string"), F.col("job_id").cast("string"), names[F.col("ord")])
    plain = F.col("job_id").isNotNull() & ~F.col("resume_id").cast("string").contains("/") & (F.col("prompt_id") == own)
    if any("/" in s.name for s in sections) or not asked.where(~F.coalesce(plain, F.lit(False))).isEmpty():
        return _assembled_by_prompt(resumes, asked, responses, sections)
    return _assembled_by_pair(resumes, asked, responses, sections)


def _header(sections: tuple[Section, ...], ord_: Column, response: Column) -> Column:
    headers = F.create_map(*[F.lit(x) for i, s in enumerate(sections) if s.header for x in (i, s.header)])
    return F.concat(F.lit("# "), headers[ord_], F.lit("\n"), F.coalesce(response, F.lit("")))


def _fixed(resumes: DataFrame, asked: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """``(resume_id, job_id, ord, body)`` of the parts that are not tailored."""
    fixed = section_rows(resumes, sections).where(F.col("section").isin([s.name for s in sections if not s.prompt]))
    return asked.select("resume_id", "job_id").distinct().join(fixed, "resume_id").select("resume_id", "job_id", "ord", "body")


def _joined_parts(parts: Column) -> Column:
    filled = F.filter(F.transform(F.sort_array(parts), lambda p: p["body"]), lambda b: b != "")
    return F.array_join(filled, "\n\n").alias("resume")


def _assembled_by_pair(resumes: DataFrame, asked: DataFrame, responses: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """``assemble`` for prompts whose ids are those of ``prompt_rows`` and tell résumé and job: a response goes straight to the pair it is for.

    So responses are shuffled once, and TURNS part by part; résumés are written once.
    """
    none = lambda kind: F.lit(None).cast(kind)
    ask, got, part = "struct<prompt_id:string,resume_id:{0},job_id:{1},ord:int>", "struct<prompt_id:string,response:string>", "struct<ord:int,body:string>"
    ask = ask.format(*(asked.schema[c].dataType.simpleString() for c in ("resume_id", "job_id")))
    pair = F.concat_ws("/", F.col("resume_id").cast("string"), F.col("job_id").cast("string"))

    def turn(i: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("pair"), F.lit(TURNS)) == i
        some = asked.withColumn("pair", pair).where(mine)
        rows = some.select("pair", F.struct("prompt_id", "resume_id", "job_id", "ord").cast(ask).alias("ask"), none(got).alias("got"), none(part).alias("part"))
        said = responses.select(F.regexp_replace("prompt_id", "/[^/]*$", "").alias("pair"), none(ask).alias("ask"), F.struct("prompt_id", "response").cast(got).alias("got"), none(part).alias("part")).where(mine)
        fixed = _fixed(resumes, some, sections).select(pair.alias("pair"), none(ask).alias("ask"), none(got).alias("got"), F.struct("ord", "body").cast(part).alias("part"))
        lists = rows.unionByName(said).unionByName(fixed).groupBy("pair").agg(*[F.collect_list(c).alias(c) for c in ("ask", "got", "part")])

        def answered(a: Column) -> Column:
            texts = F.transform(F.filter("got", lambda g: g["prompt_id"] == a["prompt_id"]), lambda g: g["response"])
            texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(none("string")))
            return F.transform(texts, lambda t: F.struct(a["ord"].alias("ord"), _header(sections, a["ord"], t).alias("body")))

        first = F.get("ask", F.lit(0))
        parts = F.concat(F.flatten(F.transform("ask", answered)), "part")
        return lists.where(F.size("ask") > 0).select(first["resume_id"].alias("resume_id"), first["job_id"].alias("job_id"), _joined_parts(parts))

    turns = [turn(i) for i in range(TURNS)]
    return materialise(turns[0], "resumes", *turns[1:])


def _assembled_by_prompt(resumes: DataFrame, asked: DataFrame, responses: DataFrame, sections: tuple[Section, ...]) -> DataFrame:
    """``assemble`` for prompt ids of any kind."""
    answered = asked.join(responses.select("prompt_id", "response"), "prompt_id", "left")
    tailored = answered.select("resume_id", "job_id", "ord", _header(sections, F.col("ord"), F.col("response")).alias("body"))
    parts = tailored.unionByName(_fixed(resumes, asked, sections))
    lists = parts.groupBy("resume_id", "job_id").agg(F.collect_list(F.struct("ord", "body")).alias("ps"))
    return lists.select("resume_id", "job_id", _joined_parts(F.col("ps")))


def is_current(status: Column, last_updated: Column, source_modified: Column) -> Column:
    done = (status == "Completed") & (F.to_date(last_updated) >= F.to_date(source_modified))
    return F.coalesce(done, F.lit(False))


def stale_sections(status: DataFrame) -> DataFrame:
    """Rows of ``(.., status, last_updated, source_modified)`` that must be built again."""
    return status.where(~is_current(F.col("status"), F.col("last_updated"), F.col("source_modified")))


def mark_in_progress(status: DataFrame, now: Column) -> DataFrame:
    return status.withColumns({"status": F.lit("In Progress"), "last_updated": now})


def apply_responses(status: DataFrame, responses: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Status after the responses came in: blank ones fail, missing ones leave the row in progress."""
    got = responses.select(*keys, "response", F.lit(True).alias("arrived"))
    joined = status.join(got, keys, "left")
    new = F.when(is_blank(F.col("response")), F.lit("Failed")).otherwise(F.lit("Completed"))
    return joined.withColumns(
        {
            "status": F.when(F.col("arrived"), new).otherwise(F.col("status")),
            "last_updated": F.when(F.col("arrived"), now).otherwise(F.col("last_updated")),
            "content": F.when(F.col("arrived") & ~is_blank(F.col("response")), F.col("response")),
        }
    ).drop("response", "arrived")


def failed_sections(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "Failed")


def build_succeeded(status: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "Failed")
    return status.agg(failed.alias("failed"), (failed == 0).alias("succeeded"))
