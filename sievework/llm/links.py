"""Canonical identity of a posting link, as Column expressions (no Python in the data path).

``posting_key`` maps every spelling of a link that opens the same posting to one string made
of site, employer and posting number. Fields: any url column. Behaviour:

* null, empty or blank links -> null (they identify nothing);
* links without a posting number -> the normalised link itself (still one key per page);
* white space, ``<...>``, scheme, ``www.``, ports, letter case of the host, doubled slashes,
  percent-escapes, tracking parameters, text fragments, language segments, slugs, ``/apply``
  tails and one level of redirect wrapper do not matter;
* host, employer and number always do: links that differ only there stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import let

#: Parameters that never identify a posting.
TRACKING = r"utm_[a-z]+|gclid|fbclid|trk|refid|src|ref|lang|n|share"
#: Path tails that open the form of the same posting.
FORM_TAIL = r"(?:/(?:apply|form))+"
#: Language segments that open a translation of the same posting.
LANG_SEGMENT = r"(?:en|he|fr|de|es|ar|ru)"


def _decoded(s: Column) -> Column:
    return F.when(s.contains("%"), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)


def clean_link(u: Column) -> Column:
    """The link without wrapper characters, scheme, port, ``www.`` and redirect; null if missing."""
    s = F.regexp_replace(u, r"[\s\u00a0<>\"]+", "")
    # a redirect keeps its target percent-encoded in the parameter u (or url, to, target)
    target = r"[?&](?:u|url|to|target)=((?:https?(?:%3[aA]|:)|[A-Za-z0-9-]+(?:\.|%2[eE])[A-Za-z])[^&#]*)"
    s = let(s, lambda x: let(F.regexp_extract(x, target, 1), lambda t: F.when(t != "", _decoded(t)).otherwise(x)))
    s = F.lower(let(s, _decoded))
    s = F.regexp_replace(s, r"^(?:[a-z][a-z0-9+.-]*:)?/+", "")
    s = F.regexp_replace(s, r"^(?:www\.)?([^/?#]*?)\.?(?::\d+)?(?=[/?#]|$)", "$1")
    return F.nullif(s, F.lit(""))


def _key(s: Column) -> Column:
    host = F.regexp_extract(s, r"^[^/?#]*", 0)
    query = F.regexp_extract(s, r"\?([^#]*)", 1)
    path = F.concat(F.regexp_extract(s, r"^[^/?#]*([^?#]*)", 1), F.lit("/"), F.regexp_extract(s, r"#!?(/.*)$", 1))
    path = F.regexp_replace(path, r"/+", "/")
    path = F.regexp_replace(path, rf"{FORM_TAIL}?/?$", "")
    path = F.regexp_replace(path, rf"^/{LANG_SEGMENT}(?=/)", "")
    # /any-slug-123456 -> /123456, and nothing after the number matters
    path = F.regexp_replace(path, r"/(?:[^/]*[-_])?(\d{4,})(?:\.html?)?(?:/.*)?$", "/$1")
    params = F.filter(F.split(query, r"[&;]"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)"))
    return F.concat_ws("|", host, path, F.array_join(F.array_sort(params), "&"))


def posting_key(u: Column) -> Column:
    """Site, employer and number of the posting behind ``u`` as one string; null if missing."""
    # a fragment that starts with a slash is the route of a one-page site, any other is a mark
    s = F.regexp_replace(clean_link(u), r"#(?!/?!?/).*$", "")
    return let(s, lambda x: F.when(x.isNotNull(), _key(x)))
