"""URL functions as Column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Hosts and path marks of the url classes.
PDF_HOSTS = "arxiv.org aclanthology.org openreview.net biorxiv.org medrxiv.org chemrxiv.org osf.io mdpi.com pmc.ncbi.nlm.nih.gov inspirehep.net zenodo.org hal.science hal.archives-ouvertes.fr europepmc.org".split()
PDF_DENIED = "github.com gitlab.com books.google.com scribd.com semanticscholar.org openalex.org researchgate.net".split()
PDF_PATHS = ".pdf /pdf/ /pdfs/ /content/pdf/ /_downloads/".split()
BOOK_HOSTS = (
    "amazon.com amazon.de amazon.in amazon.co.uk abebooks.de thalia.de barnesandnoble.com kulturkaufhaus.de buecher.de hugendubel.info"
    " beck-shop.de exsila.ch booklooker.de buchshop.bod.de books.apple.com ebooks.com audible.com blinkist.com perlego.com ebookaktiv.de"
    " legimi.de e-booksdirectory.com hqaudiobooks.net book-sharing.de downmagaz.net ebooksyard.com oreilly.com manning.com"
    " simonandschuster.com penguinrandomhouse.com hachettebookgroup.com fischerverlage.de chbeck.de bloomsbury.com penguin.de tharpa.com"
    " bibleandbookcenter.com goodreads.com gutenberg.org openlibrary.org archive.org books.google.com deutsche-digitale-bibliothek.de"
    " en.wikisource.org yumpu.com worldmags.net drive.google.com fivebooks.com bookauthority.org ordertoread.com reedsy.com"
    " bookseriesinorder.com booksinorder.org infobooks.org booksaremythirdplace.com eatyourbooks.com fictionhorizon.com shortform.com"
    " dedp.online harrypotter.com refactoring.guru formdesignpatterns.com cleancodecookbook.com superfastpython.com pythonbooks.org"
    " buddho.org berniegourley.com eternalisedofficial.com"
).split()
BOOK_DENIED = "github.com gitlab.com bitbucket.org gist.github.com".split()
BOOK_PATHS = "/books/ /buecher/ /buch/ /book/show/ /dp/ /ebooks/ /detail/isbn- /library/view/ /title/ /ebook/".split()
DOCS_DENIED = "reddit.com stackoverflow.com bugs.python.org medium.com youtube.com dev.to github.com gitlab.com bitbucket.org w3schools.com geeksforgeeks.org freecodecamp.org codezup.com riptutorial.com slideshare.net scribd.com deepwiki.com".split()
DOCS_DENIED_PATHS = ["/blog/", "/community/"]
#: Academic hosts by tier.
TIERS = [
    ("T1", "arxiv.org aclanthology.org openreview.net pmc.ncbi.nlm.nih.gov".split()),
    ("T2", "openalex.org semanticscholar.org".split()),
    ("T3", ["doi.org"]),
    ("T4", (
        "dl.acm.org link.springer.com ieeexplore.ieee.org jstor.org books.google.com sciencedirect.com muse.jhu.edu mdpi.com"
        " onlinelibrary.wiley.com nature.com springer.com tandfonline.com researchgate.net direct.mit.edu biorxiv.org medrxiv.org ssrn.com"
        " cambridge.org oup.com acm.org worldscientific.com frontiersin.org plos.org hindawi.com thieme-connect.com search.proquest.com"
        " scribd.com spiedigitallibrary.org elib.uni-stuttgart.de cyberleninka.ru inspirehep.net search.ebscohost.com"
    ).split()),
]
#: Marks of documentation urls: code, in host or path, how, what.
DOCS_MARKS = [
    ("H1", "host", "starts", ["docs."]), ("H2", "host", "holds", [".readthedocs.io"]), ("H3", "host", "holds", [".gitbook.io"]), ("H4", "host", "holds", [".notion.site"]),
    ("H5", "host", "starts", ["developer.", "developers."]), ("H6", "path", "holds", ["/docs/"]), ("H7", "path", "holds", ["/documentation/"]), ("H8", "path", "holds", ["/reference/"]),
    ("H9", "path", "holds", ["/guide/"]), ("H10", "path", "holds", ["/api/"]), ("H11", "path", "holds", ["/tutorial/"]), ("H12", "path", "holds", ["/manual/"]), ("H13", "path", "holds", ["/learn/"]),
]
#: Fixed value: urls of search result pages.
SEARCH_PAGE = r"[?&](q|query|search|keyword|term|p)=|/search/|/sresults/|/scholar\?q="
#: Modes whose queries get a word, and the engines that get it.
MODE_WORDS, MODE_ENGINES = {"books": "book", "pdf": "pdf", "docs": "documentation"}, ["google", "duckduckgo", "mojeek"]


def url_hash(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(12))


def cache_key(query: Column, language: Column, engines: Column, time_range: Column) -> Column:
    """Key of a cached search: nulls count as empty, so each part keeps its place."""
    parts = [F.regexp_replace(F.lower(query), r"(?U)^\s+|\s+$", ""), language, F.coalesce(engines, F.lit("")), F.coalesce(time_range, F.lit(""))]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column) -> Column:
    """Lower-cased authority without a leading www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def host_label(url: Column) -> Column:
    """Host name without user, port and leading www."""
    host = F.regexp_replace(F.lower(authority(url)), r"^[^@]*@|:\d+$", "")
    return F.regexp_replace(host, r"^www\.", "")


def crawl_normal(url: Column) -> Column:
    """Without query, fragment, `/name@version` segments and all trailing slashes."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/[^/]+@[^/]+(?=/|$)", ""), r"/+$", "")


def dedup_normal(url: Column) -> Column:
    """Without one trailing slash."""
    return F.regexp_replace(url, "/$", "")


def in_hosts(host: Column, hosts: list[str]) -> Column:
    """The host is one of these or a subdomain of one: a set lookup per suffix instead of a test per host."""
    most = max(h.count(".") for h in hosts) + 1
    suffixes = F.array(*[F.substring_index(host, ".", -k) for k in range(1, most + 1)])
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, hosts)))


def _holds(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def is_pdf(url: Column) -> Column:
    d = domain(url)
    return F.when(in_hosts(d, PDF_DENIED), False).when(in_hosts(d, PDF_HOSTS), True).otherwise(_holds(F.lower(path(url)), PDF_PATHS))


def is_book(url: Column) -> Column:
    d = domain(url)
    return F.when(in_hosts(d, BOOK_DENIED), False).when(in_hosts(d, BOOK_HOSTS), True).otherwise(_holds(F.lower(path(url)), BOOK_PATHS))


def is_docs(url: Column) -> Column:
    return ~in_hosts(domain(url), DOCS_DENIED) & ~_holds(F.lower(path(url)), DOCS_DENIED_PATHS)


def in_mode(url: Column, mode: str) -> Column:
    return {"pdf": is_pdf, "books": is_book, "docs": is_docs}.get(mode, lambda _: F.lit(True))(url)


def is_pdf_by_path(url: Column, hosts: list[str]) -> Column:
    """The narrower test: a path that ends in .pdf, or a listed host."""
    return F.lower(path(url)).endswith(".pdf") | in_hosts(domain(url), hosts)


def is_book_by_path(url: Column, hosts: list[str]) -> Column:
    """The narrower test: a listed host, or the sites' own paths of books."""
    d, u = domain(url), F.lower(url)
    special = (d.contains("amazon.") & u.contains("/dp/")) | ((d == "archive.org") & u.contains("/details/")) | ((d == "springer.com") & u.contains("/book/")) | (d == "jstor.org")
    return in_hosts(d, hosts) | special


def tier(url: Column) -> Column:
    """First tier that lists the domain; null for others."""
    d = domain(url)
    return F.coalesce(*[F.when(d.isin(hosts), F.lit(name)) for name, hosts in TIERS])


def docs_marks(url: Column) -> Column:
    """Codes of all documentation marks that fit."""
    d, p = domain(url), path(url)
    tests = []
    for code, where, how, what in DOCS_MARKS:
        at = d if where == "host" else p
        hit = F.lit(False)
        for w in what:
            hit = hit | (at.startswith(w) if how == "starts" else at.contains(w))
        tests.append(F.when(hit, F.lit(code)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def is_search_page(url: Column) -> Column:
    return url.rlike(SEARCH_PAGE)


def pdf_url(url: Column) -> Column:
    """Where a paper's pdf lies, for the sites whose urls tell."""
    d = domain(url)
    return (
        F.when(d == "arxiv.org", F.regexp_replace(url, r"/(abs|html)/", "/pdf/"))
        .when((d == "aclanthology.org") & ~url.endswith(".pdf"), F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".pdf")))
        .when(d == "openreview.net", F.regexp_replace(url, r"/forum\?", "/pdf?"))
        .otherwise(url)
    )


def has_real_path(url: Column) -> Column:
    return ~path(url).isin("", "/")


def modified_query(query: Column, engine: Column, mode: Column) -> Column:
    word = F.coalesce(*[F.when(mode == m, F.lit(w)) for m, w in MODE_WORDS.items()])
    return F.when(engine.isin(MODE_ENGINES) & word.isNotNull(), F.concat(query, F.lit(" "), word)).otherwise(query)


def query_slug(query: Column) -> Column:
    """Runs of others than [a-z0-9] become _; 30 characters are kept first, then outer _ go."""
    return F.regexp_replace(F.left(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "_"), F.lit(30)), "^_+|_+$", "")


def file_name(url: Column) -> Column:
    """Scheme dropped, others than letters and digits as one _, outer _ stripped, 100 characters."""
    bare = F.regexp_replace(url, "^https?://", "")
    return F.left(F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""), F.lit(100))


def url_slug(url: Column) -> Column:
    """As file_name, with - and 80 characters."""
    bare = F.regexp_replace(url, "^https?://", "")
    return F.left(F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""), F.lit(80))


def page_file(url: Column, prefix: Column) -> Column:
    """Prefix and path as one name: extension off, / as __, `index` where nothing is left."""
    p = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), r"\.html?$", "")
    return F.concat(prefix, F.when(p == "", "index").otherwise(F.replace(p, F.lit("/"), F.lit("__"))), F.lit(".md"))


def publication_date(stated: Column, url: Column, default: str) -> Column:
    """First ten characters of a stated time, else the date in the url's path, else the default."""
    in_url = F.regexp_extract(url, r"/(\d{4})/(\d{2})/(\d{2})/", 0)
    return F.when(F.length(stated) >= 10, F.left(stated, F.lit(10))).when(in_url != "", F.replace(F.substring(in_url, 2, 10), F.lit("/"), F.lit("-"))).otherwise(default)


def section(url: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(path(url), "/"), lambda s: s != ""), 0), F.lit(""))


def is_live_blog(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1).startswith("live-")


def proxy_key(proxy: Column) -> Column:
    """protocol://host:port of an address that may hold a user; leading zeros of the port go."""
    proto = F.substring_index(proxy, "://", 1)
    rest = F.substring_index(F.substring_index(proxy, "://", -1), "@", -1)
    host, port = F.substring_index(rest, ":", 1), F.try_to_number(F.substring_index(rest, ":", -1), F.lit("99999")).cast("int")
    return F.concat(proto, F.lit("://"), host, F.lit(":"), port.cast("string"))


def unwrapped(url: Column, host_pattern: str, parameter: str) -> Column:
    """The target in a redirect's query parameter, decoded; the url itself where it is no such redirect."""
    raw = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(url.rlike(host_pattern) & (raw != ""), F.coalesce(F.try_url_decode(raw), url)).otherwise(url)


def unwrapped_base64(url: Column) -> Column:
    """The target in a tracking url's `u`: two characters, then base64url of any length; bytes that are no UTF-8 are left out (and with
    them U+FFFD, which stands for them). The url itself where there is no such parameter or it is no base64."""
    raw = F.regexp_extract(url, r"[?&]u=([^&#]*)", 1)
    code = F.translate(F.substr(raw, F.lit(3)), "-_", "+/")
    padded = F.concat(code, F.repeat(F.lit("="), ((4 - F.length(code) % 4) % 4).cast("int")))
    text = F.translate(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), "\ufffd", "")
    return F.when(url.contains("/ck/a?") & (F.length(raw) > 2), F.coalesce(text, url)).otherwise(url)


def outcome(status: Column, n_bytes: Column, error: Column | None = None) -> Column:
    """How a fetch went: an acquisition error, 429, another error status, too little, or ok; the first that holds."""
    out = F.when(status == 429, "waf_429").when(status >= 400, "http_error").when(n_bytes < 100, "empty").otherwise("ok")
    return out if error is None else F.when(error.isNotNull(), "error").otherwise(out)


def gate(status: Column, body: Column, markers: list[str], *, ignore_case: bool = False) -> Column:
    """dead for 404 and 410; fail for other than 200 or without any of the markers in the first 500 bytes (html is searched
    without regard to case, by lower-case markers); else ok. A null body has no marker."""
    head = F.hex(F.substring(body.cast("binary"), 1, 500))
    # case is that of ASCII letters, bytes 41 to 5A; two hex digits a byte, so a marker is looked for at even places only
    head = F.regexp_replace(head, "(..)", "$1 ")
    if ignore_case:
        head = F.regexp_replace(F.regexp_replace(head, "4([1-9A-F]) ", "6$1 "), "5([0-9A]) ", "7$1 ")
    code = lambda m: "".join(f"{b:02X} " for b in (m.lower() if ignore_case else m).encode())
    held = F.lit(False)
    for m in markers:
        held = held | head.contains(code(m))
    return F.when(status.isin(404, 410), "dead").when(status != 200, "fail").when(F.coalesce(held, F.lit(False)), "ok").otherwise("fail")


def has_signal(text: Column, signals: list[str]) -> Column:
    return _holds(text, signals)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first (pattern, label) that is found in the text."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules], F.lit(default))


def connect_fail(error: Column) -> Column:
    """Kind of a failed connection, by its text: a page's own timeout, the network's, a proxy's refusal, or another."""
    low = F.lower(F.coalesce(error, F.lit("")))
    proxy = low.contains("err_proxy") | low.contains("err_tunnel") | low.contains("socks")
    return F.when(low.contains("ms exceeded"), "page_timeout").when(low.contains("net::err_timed_out"), "net_timed_out").when(proxy, "proxy_connect").otherwise("other")


def page_shape(host: Column, shapes: list[tuple[str, str]], default: str = "other") -> Column:
    """The shape of the first (mark, shape) whose mark the host holds."""
    return F.coalesce(*[F.when(host.contains(m), F.lit(shape)) for m, shape in shapes], F.lit(default))


@F.pandas_udf(StringType())
def config_hash(config: pd.Series) -> pd.Series:
    """First ten hex digits of the SHA-256 of a configuration's JSON with sorted keys, as Python writes it."""
    return config.map(lambda c: hashlib.sha256(json.dumps(json.loads(c), sort_keys=True).encode()).hexdigest()[:10], na_action="ignore")
