"""Recorded answers of search services, projected to one table of search results.

Each connector names the answer's schema, the list of its items and the columns
of a result. Answers are rows (source_name, query, body); a body that isn't the
service's JSON gives no results, as a failed request does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = (
    "query string, source_name string, source_category string, source_tier string, position long, title string, url string, snippet string, "
    "published_date string, authors array<string>, citation_count long, open_access boolean, doi string"
)
_COLUMNS = [part.split(" ")[0] for part in RESULT.split(", ")]


@dataclass(frozen=True)
class Connector:
    """``item`` is the DDL of one item, ``path`` leads to the list of items; ``fields`` makes result columns of an item."""

    category: str
    tier: str
    path: str
    item: str
    fields: Callable[[Column], dict[str, Column]]
    always: dict[str, Column] = field(default_factory=dict)

    @property
    def schema(self) -> str:
        out = f"array<struct<{self.item}>>"
        for name in reversed(self.path.split(".")):
            out = f"struct<{name}:{out}>"
        return out


def _text(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _first(*options: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(c != "", c) for c in options], F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("string")


def _named(people: Column) -> Column:
    return F.coalesce(F.filter(F.transform(people, lambda p: p["name"]), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def _head(c: Column, n: int) -> Column:
    return F.substring(_text(c), 1, n)


def _semantic_scholar(p: Column) -> dict[str, Column]:
    return {
        "title": _text(p["title"], "Untitled"),
        "url": _first(p["url"], F.concat(F.lit("https://semanticscholar.org/paper/"), _text(p["paperId"]))),
        "snippet": F.concat(F.lit("Cited "), _number(p["citationCount"]), F.lit(" times. "), F.when(p["isOpenAccess"], "Open access available.").otherwise("")),
        "published_date": p["year"].cast("string"),
        "authors": _named(p["authors"]),
        "citation_count": p["citationCount"],
        "open_access": F.coalesce(p["isOpenAccess"], F.lit(False)),
        "doi": p["externalIds"]["DOI"],
    }


def _crossref(p: Column) -> dict[str, Column]:
    doi = _text(p["DOI"])
    names = F.transform(p["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return {
        "title": _text(F.get(p["title"], F.lit(0)), "Untitled"),
        "url": F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(_text(p["URL"])),
        "snippet": F.when(_text(p["abstract"]) != "", _head(p["abstract"], 300)).otherwise(F.concat(F.lit("DOI: "), doi)),
        "published_date": F.get(F.get(p["published-print"]["date-parts"], F.lit(0)), F.lit(0)).cast("string"),
        "authors": F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>")),
        "citation_count": p["is-referenced-by-count"],
        "open_access": F.coalesce(F.exists(p["license"], lambda x: x["content-version"].eqNullSafe("vor")), F.lit(False)),
        "doi": doi,
    }


def _openalex(p: Column) -> dict[str, Column]:
    where = _first(p["primary_location"]["landing_page_url"], p["doi"])
    names = F.transform(p["authorships"], lambda a: F.struct(a["author"]["display_name"].alias("name")))
    return {
        "title": _text(p["title"], "Untitled"),
        "url": F.when((where != "") & ~where.startswith("http"), F.concat(F.lit("https://doi.org/"), where)).otherwise(where),
        "snippet": F.concat(F.lit("Cited "), _number(p["cited_by_count"]), F.lit(" times. "), F.when(p["open_access"]["is_oa"], "Open access.").otherwise("")),
        "published_date": p["publication_year"].cast("string"),
        "authors": _named(names),
        "citation_count": p["cited_by_count"],
        "open_access": F.coalesce(p["open_access"]["is_oa"], F.lit(False)),
        "doi": p["doi"],
    }


def _doaj(p: Column) -> dict[str, Column]:
    b = p["bibjson"]
    return {
        "title": _text(b["title"], "Untitled"),
        "url": _text(F.get(b["link"], F.lit(0))["url"]),
        "snippet": _head(b["abstract"], 300),
        "published_date": b["year"],
        "authors": _named(b["author"]),
        "open_access": F.lit(True),
        "doi": b["doi"],
    }


def _clinical_trials(p: Column) -> dict[str, Column]:
    s = p["protocolSection"]
    nct, phases = _text(s["identificationModule"]["nctId"]), s["designModule"]["phases"]
    phase = F.when(F.size(phases) > 0, F.array_join(phases, ", ")).otherwise("N/A")
    return {
        "title": _text(s["identificationModule"]["briefTitle"], "Untitled"),
        "url": F.concat(F.lit("https://clinicaltrials.gov/study/"), nct),
        "snippet": F.concat(F.lit("Status: "), _text(s["statusModule"]["overallStatus"]), F.lit(". Phase: "), phase, F.lit(". NCT: "), nct),
        "published_date": s["statusModule"]["startDateStruct"]["date"],
    }


def _wikidata(p: Column) -> dict[str, Column]:
    return {"title": _text(p["label"]), "url": F.concat(F.lit("https://www.wikidata.org/wiki/"), _text(p["id"])), "snippet": _text(p["description"])}


def _github(p: Column) -> dict[str, Column]:
    return {
        "title": _text(p["full_name"]),
        "url": _text(p["html_url"]),
        "snippet": F.concat_ws(" | ", F.concat(F.lit("⭐ "), _number(p["stargazers_count"])), _text(p["language"]), _head(p["description"], 200)),
        "published_date": _head(p["created_at"], 10),
    }


def _stackoverflow(p: Column) -> dict[str, Column]:
    body = F.substring(F.regexp_replace(_text(p["body"]), "<[^>]+>", ""), 1, 300)
    return {
        "title": _text(p["title"]),
        "url": _text(p["link"]),
        "snippet": F.concat_ws(" | ", F.concat(F.lit("Score: "), _number(p["score"])), F.concat(F.lit("Answers: "), _number(p["answer_count"])), body),
    }


def _hackernews(p: Column) -> dict[str, Column]:
    return {
        "title": _text(p["title"]),
        "url": _first(p["url"], F.concat(F.lit("https://news.ycombinator.com/item?id="), _text(p["objectID"]))),
        "snippet": F.concat(F.lit("Points: "), _number(p["points"]), F.lit(" | Comments: "), _number(p["num_comments"])),
        "published_date": _head(p["created_at"], 10),
    }


def _brave(p: Column) -> dict[str, Column]:
    return {"title": _text(p["title"]), "url": _text(p["url"]), "snippet": _text(p["description"]), "published_date": _text(p["age"])}


def _tavily(p: Column) -> dict[str, Column]:
    return {"title": _text(p["title"]), "url": _text(p["url"]), "snippet": _head(p["content"], 500), "published_date": _text(p["published_date"])}


def _newsapi(p: Column) -> dict[str, Column]:
    return {
        "title": _first(p["title"], F.lit("Untitled")),
        "url": _text(p["url"]),
        "snippet": _first(p["description"], _head(p["content"], 300)),
        "published_date": _head(p["publishedAt"], 10),
        "authors": F.when(_text(p["author"]) != "", F.array(p["author"])).otherwise(F.array().cast("array<string>")),
    }


def _core(p: Column) -> dict[str, Column]:
    doi = _text(p["doi"])
    return {
        "title": _text(p["title"], "Untitled"),
        "url": _first(p["downloadUrl"], F.get(p["sourceFulltextUrls"], F.lit(0)), F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))),
        "snippet": _head(p["abstract"], 300),
        "published_date": p["yearPublished"].cast("string"),
        "authors": _named(p["authors"]),
        "open_access": F.lit(True),
        "doi": doi,
    }


_NAMES = "array<struct<name:string>>"
CONNECTORS = {
    "semantic_scholar": Connector(
        "academic", "P1", "data",
        f"paperId:string,title:string,url:string,year:int,citationCount:bigint,isOpenAccess:boolean,authors:{_NAMES},externalIds:struct<DOI:string>", _semantic_scholar,
    ),
    "crossref": Connector(
        "academic", "P1", "message.items",
        "DOI:string,URL:string,title:array<string>,abstract:string,author:array<struct<given:string,family:string>>,"
        "`published-print`:struct<`date-parts`:array<array<int>>>,license:array<struct<`content-version`:string>>,`is-referenced-by-count`:bigint", _crossref,
    ),
    "openalex": Connector(
        "academic", "P1", "results",
        "title:string,doi:string,publication_year:int,cited_by_count:bigint,open_access:struct<is_oa:boolean>,primary_location:struct<landing_page_url:string>,"
        "authorships:array<struct<author:struct<display_name:string>>>", _openalex,
    ),
    "doaj": Connector("academic", "P1", "results", f"bibjson:struct<title:string,link:array<struct<url:string>>,abstract:string,year:string,author:{_NAMES},doi:string>", _doaj),
    "clinical_trials": Connector(
        "clinical", "P1", "studies",
        "protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>>,"
        "designModule:struct<phases:array<string>>>", _clinical_trials,
    ),
    "wikidata": Connector("encyclopedia", "P2", "search", "id:string,label:string,description:string", _wikidata),
    "github": Connector("code", "P3", "items", "full_name:string,html_url:string,stargazers_count:bigint,language:string,description:string,created_at:string", _github),
    "stackoverflow": Connector("code", "P3", "items", "title:string,link:string,score:bigint,answer_count:bigint,body:string", _stackoverflow),
    "hackernews": Connector("news", "P3", "hits", "title:string,url:string,objectID:string,points:bigint,num_comments:bigint,created_at:string", _hackernews),
    "brave": Connector("web", "P3", "web.results", "title:string,url:string,description:string,age:string", _brave),
    "tavily": Connector("web", "P3", "results", "title:string,url:string,content:string,published_date:string", _tavily),
    "newsapi": Connector("news", "P3", "articles", "title:string,url:string,description:string,content:string,publishedAt:string,author:string", _newsapi),
    "core": Connector(
        "academic", "P1", "results",
        f"title:string,doi:string,downloadUrl:string,sourceFulltextUrls:array<string>,authors:{_NAMES},abstract:string,yearPublished:int", _core,
    ),
}


def results_of(answers: DataFrame, name: str) -> DataFrame:
    """The results (RESULT) in one connector's answers (source_name, query, body), numbered in the order of each answer.

    Columns the service doesn't give are null, authors an empty list. A null or
    broken body gives no rows.
    """
    connector = CONNECTORS[name]
    parsed = F.from_json("body", connector.schema)
    for step in connector.path.split("."):
        parsed = parsed[step]
    items = answers.where(F.col("source_name") == name).select("query", F.posexplode(parsed).alias("position", "item"))
    made = {
        "source_name": F.lit(name), "source_category": F.lit(connector.category), "source_tier": F.lit(connector.tier),
        "authors": F.array().cast("array<string>"), **connector.fields(F.col("item")),
    }
    kinds = dict(part.split(" ") for part in RESULT.split(", "))
    return items.where("item is not null").select(
        *[(made[c] if c in made else F.col(c) if c in ("query", "position") else F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS]
    )


def search_results(answers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All connectors' results in one table; the answers are read once per connector and filtered at the scan."""
    parts = [results_of(answers, n) for n in names or CONNECTORS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def by_source(results: DataFrame) -> DataFrame:
    """(query, source_name, results): how every source answered a query, its results in their order."""
    row = F.struct("position", "title", "url", "snippet", "source_tier")
    return results.groupBy("query", "source_name").agg(F.sort_array(F.collect_list(row)).alias("results"))


#: What a registry record says of updates to a paper.
_RECORD = "message struct<title:array<string>, assertion:array<struct<name:string,value:string>>, `update-to`:array<struct<type:string,label:string,`updated-date`:string>>>"


def retractions(records: DataFrame, ident: str = "doi", body: str = "body") -> DataFrame:
    """(ident, is_retracted, notice, retracted_at) of recorded registry answers (ident, body JSON).

    An assertion, an update or a title may say so; the last of these that does gives
    the notice. A record that can't be read says nothing.
    """
    def says(text) -> object:
        return F.coalesce(F.contains(F.lower(text), F.lit("retract")), F.lit(False))

    m = records.select(ident, F.from_json(body, _RECORD)["message"].alias("m"))
    asserted = F.filter("m.assertion", lambda a: F.coalesce(a["name"] == "retracted", F.lit(False)) | says(a["value"]))
    updated = F.filter(F.col("m")["update-to"], lambda u: says(u["type"]))
    titled = F.filter("m.title", says)
    last = m.select(ident, *[F.try_element_at(x, F.lit(-1)).alias(n) for n, x in (("a", asserted), ("u", updated), ("t", titled))])
    notice = F.coalesce(F.col("t"), F.when(F.col("u").isNotNull(), F.coalesce("u.label", F.lit("Retracted"))), F.when(F.col("a").isNotNull(), F.coalesce("a.value", F.lit(""))))
    return last.select(ident, notice.isNotNull().alias("is_retracted"), F.coalesce(notice, F.lit("")).alias("notice"), F.coalesce(F.col("u")["updated-date"], F.lit("")).alias("retracted_at"))
