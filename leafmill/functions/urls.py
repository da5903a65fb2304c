"""URLs as column expressions: parts, registered domain, canonical form, slug."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import urlspec
from leafmill.sources.suffixes import Suffixes

# Public suffixes of two labels that are in wide use. Others are taken to have one label.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk net.uk ltd.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn co.in net.in org.in ac.in gov.in "
    "co.kr or.kr ac.kr go.kr com.mx org.mx gob.mx com.ar org.ar com.tr org.tr com.tw org.tw edu.tw com.hk org.hk com.sg edu.sg "
    "co.za org.za ac.za com.pl org.pl com.ua co.il org.il ac.il com.my com.ph com.vn co.id or.id ac.id co.th ac.th com.es com.pt"
).split()
# Parameters that only track; names that may mean something (ref, source, campaign) stay.
TRACKING = r"(?i)^(?:utm_|(?:fbclid|gclid|gclsrc|dclid|msclkid|mc_eid|mc_cid|igshid|ref_src|ref_url|spm|_hsenc|_hsmi|vero_id|yclid|wt_mc|cmpid)\z)"
# Endings of files that are no reading matter, and of plain text.
MEDIA = "png jpg jpeg gif svg webp bmp tiff ico mp4 mp3 avi mov wmv flv mkv json xml".split()
RAW_TEXT = "md txt rst csv tsv".split()

_PLAIN_PATH = r"^https?://[A-Za-z0-9.:@_-]*(?:/[A-Za-z0-9/._~!$&'()*,;=:@+-]*)?(?:\?[\x21-\x7e]*)?\z"


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(location: Column) -> Column:
    """Host name, in lower case, of a netloc with or without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(location, r"^.*@", ""), r":[^:\]]*\z", ""))


def path(url: Column) -> Column:
    """The path without parameters of its last segment, as urlparse splits it."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*\z", "")


def registered_domain(url: Column, suffixes: Suffixes | list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The domain under the public suffix, "" of an address, a single label or a bare suffix.

    ``suffixes`` are those of ``sources.suffixes.read_suffixes``, or a list of such of two labels.
    """
    known = suffixes if isinstance(suffixes, Suffixes) else Suffixes(frozenset(suffixes))
    h = F.regexp_replace(host(netloc(url)), r"\.\z", "")
    if known.labels() > 2 or known.wildcards or known.exceptions:
        return _let(h, lambda name: _let(_suffix_labels(name, known), lambda of: _registered(name, of, known.labels())))
    wide = F.substring_index(h, ".", -2).isin(sorted(known.rules))
    labels = F.size(F.split(h, r"\."))
    return (
        F.when(h.rlike(_ADDRESS) | (labels < 2) | (wide & (labels == 2)), F.lit(""))
        .when(wide, F.substring_index(h, ".", -3))
        .otherwise(F.substring_index(h, ".", -2))
    )


_ADDRESS = r"^\d{1,3}(?:\.\d{1,3}){3}\z|[\[\]]"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is worked out once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _suffix_labels(name: Column, known: Suffixes) -> Column:
    """Labels of the public suffix of a host: those of the longest rule that holds, one without any."""
    of = F.lit(1)
    for k in range(2, known.labels() + 1):
        tail, parent = F.substring_index(name, ".", -k), F.substring_index(name, ".", 1 - k)
        rule = tail.isin(sorted(x for x in known.rules if x.count(".") == k - 1))
        if wild := sorted(x for x in known.wildcards if x.count(".") == k - 2):
            rule = rule | parent.isin(wild)
        of = F.when((F.size(F.split(name, r"\.")) >= k) & rule, F.lit(k)).otherwise(of)
        if exceptions := sorted(x for x in known.exceptions if x.count(".") == k - 1):
            of = F.when(tail.isin(exceptions), F.lit(k - 1)).otherwise(of)
    return of


def _registered(name: Column, of: Column, most: int) -> Column:
    found = F.lit("")
    for k in range(1, most + 1):
        found = F.when(of == k, F.substring_index(name, ".", -k - 1)).otherwise(found)
    return F.when(name.rlike(_ADDRESS) | (F.size(F.split(name, r"\.")) <= of), F.lit("")).otherwise(found)


def domain_for_url(url: Column, suffixes: Suffixes | list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """What a URL is filed under: the registered domain, else its netloc in lower case without www."""
    found = registered_domain(url, suffixes)
    return F.when(found != "", found).otherwise(F.regexp_replace(F.lower(netloc(url)), r"^www\.", ""))


def slug_for_url(url: Column, domain: Column | None = None) -> Column:
    """Folder name of a page: its domain, made safe, and 64 bits of the URL's hash."""
    safe = F.regexp_replace(domain if domain is not None else domain_for_url(url), r"[^A-Za-z0-9.\-]", "-")
    return F.concat(F.when(safe == "", F.lit("unknown")).otherwise(safe), F.lit("-"), F.left(F.md5(url), F.lit(16)))


def is_raw_text_url(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:%s)\z" % "|".join(RAW_TEXT))


def is_pdf_url(url: Column) -> Column:
    """A path that ends in .pdf, or lies below a first segment "pdf"."""
    p = F.lower(path(url))
    return p.rlike(r"\.pdf\z") | p.rlike(r"^/*pdf/+[^/]")


def tracking_parameter(name: Column) -> Column:
    return name.rlike(TRACKING)


def canonical_query(query: Column) -> Column:
    """The query's parameters decoded, without trackers, in order, and encoded again."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    def encoded(text: Column) -> Column:
        return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    kept = F.filter(
        F.transform(
            pairs,
            lambda p: F.struct(
                decoded(F.substring_index(p, "=", 1)).alias("k"),
                F.when(F.instr(p, "=") > 0, decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise(F.lit("")).alias("v"),
            ),
        ),
        lambda s: ~tracking_parameter(s["k"]),
    )
    return F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(encoded(s["k"]), F.lit("="), encoded(s["v"]))), "&")


@F.pandas_udf(T.StringType())
def _canonical_residue(url: pd.Series) -> pd.Series:
    return url.map(urlspec.canonical, na_action="ignore")


def with_canonical(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with the canonical form of URL column ``source`` as ``target``.

    Plain ASCII URLs stay in the JVM. The others (percent escapes, other
    scripts) go to a Python function, to which all plain ones look null.
    """
    url = F.col(source)
    plain = url.rlike(_PLAIN_PATH) & ~url.contains("%")
    location = netloc(url)
    port = F.regexp_extract(location, r":([^:@\]]*)\z", 1)
    bad_port = (port != "") & ~port.rlike(r"^\d{1,5}\z")
    name = F.regexp_replace(host(location), r"^www\.", "")
    shown = F.when(port.isin("", "80", "443"), name).otherwise(F.concat(name, F.lit(":"), F.regexp_replace(port, r"^0+(?=\d)", "")))
    whole_path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+\z", "")
    query = canonical_query(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    built = F.concat(
        F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)),
        F.lit("://"),
        shown,
        F.when(whole_path == "", F.lit("/")).otherwise(whole_path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    odd = _canonical_residue(F.when(~plain, url))
    return df.withColumn(target, F.when(url.isNull(), F.lit(None)).when(~plain, odd).when(bad_port, url).otherwise(built))
