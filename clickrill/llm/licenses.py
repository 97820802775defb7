"""License and notice scans by ordered signature rules, in built-in functions only.

A text is brought to lower-case words joined by single spaces. A handful of root strings gate the documents, the most
telling stretch of plain text that all matches of a rule hold gates the rule, and only then its regular expression runs. Detections are word intervals; one contained in another
of the same or a higher priority is suppressed, by one pass over the intervals ordered by start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, unused

#: (label, keyword, phrase): every place counts, suppressed or not.
BASE = [("cc-by", "cc by", "cc by"), ("gpl", "general public license", "general public license"), ("reserved", "all rights reserved", "all rights reserved")]
#: Every keyword below contains one of these.
ROOTS = ["licen", "creative commons", " cc", "gpl", "gfdl", "copyright", "rights", "public domain", "copyleft", "permission", "warrant", "without limitation", "unlicense", "proprietary", "confidential", "trademark", "redistribut", "spdx", "open source", "terms of", "perl itself", "lizenz", "cecill", "good not evil", "vorbehalten", "consent", "trade secret"]
_V = "(?:version |v)?"
_LATER = "(?: or (?:any |at your option any )?(?:later|newer|greater)(?: version)?| only)?"


def _creative_commons() -> list[tuple[str, int, str, str]]:
    kinds = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    out = []
    for short, long in kinds.items():
        label = "cc-" + short.replace(" ", "-")
        out += [(label, 2, "cc " + short[:2], f"cc {short}(?: licen[cs]e)?"), (label, 2, "creative commons", f"creative commons (?:{long}|{short})(?: licen[cs]e)?")]
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tail = f" {_V}{v}(?: (?:international|unported|generic|[a-z]{{2}}))?(?: (?:public )?licen[cs]e)?"
            out += [(f"{label}-{v.replace(' ', '.')}", 3, "cc " + short[:2], f"cc {short}{tail}"), (f"{label}-{v.replace(' ', '.')}", 3, "creative commons", f"creative commons {long}{tail}")]
    return out


def _gnu() -> list[tuple[str, int, str, str]]:
    names = {"gpl": ("general public licen[cs]e", ["1", "2", "3"]), "lgpl": ("(?:lesser|library) general public licen[cs]e", ["2", "2 1", "3"]), "agpl": ("affero general public licen[cs]e", ["1", "3"]), "gfdl": ("free documentation licen[cs]e", ["1 1", "1 2", "1 3"])}
    out = []
    for short, (long, versions) in names.items():
        out += [(short, 2, "licen", f"(?:gnu )?{long}"), (short, 1, short, f"(?:gnu )?{short}(?: licen[cs]ed?)?")]
        for v in versions:
            label, v0 = f"{short}-{v.replace(' ', '.')}", v if " " in v else f"{v}(?: 0)?"
            out += [(label, 3, "licen", f"(?:gnu )?{long} (?:as published by the free software foundation )?(?:either )?{_V}{v0}{_LATER}"), (label, 2, short, f"(?:gnu )?{short} ?{_V}{v0}{_LATER}"), (label, 3, "spdx", f"spdx license identifier {short} {v0}{_LATER}")]
    return out


#: label, priority (3: a named version or a distinctive sentence; 2: a name; 1: a hint), keyword, regular expression over words
_HAND = """
apache-2.0 3 licen (?:licensed under )?(?:the )?apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0 3 licen apache 2 0 license
apache-1.1 3 licen apache (?:software )?license (?:version |v)?1 1
apache-1.0 3 licen apache (?:software )?license (?:version |v)?1 0
apache 2 licen apache (?:software )?license
apache-2.0 3 licen you may not use this file except in compliance with the license
apache-2.0 3 warrant distributed on an as is basis without warranties or conditions of any kind
apache-2.0 3 spdx spdx license identifier apache 2 0
mit 3 licen (?:released |licensed |distributed )?under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit 2 licen mit licen[cs]ed?
mit 3 permission permission is hereby granted free of charge to any person obtaining a copy
mit 3 without limitation without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit 3 spdx spdx license identifier mit
mit-0 3 licen mit (?:no attribution|0) licen[cs]e
x11 2 licen x11 licen[cs]e
expat 2 licen expat licen[cs]e
bsd-2-clause 3 licen (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e
bsd-3-clause 3 licen (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e
bsd-4-clause 3 licen (?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e
0bsd 3 licen (?:0bsd|zero clause bsd|bsd zero clause) licen[cs]e
bsd 2 licen bsd (?:style )?licen[cs]ed?
bsd 3 redistribut redistribution and use in source and binary forms with or without modification are permitted
bsd 3 redistribut redistributions of source code must retain the above copyright notice
bsd 3 redistribut redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 3 permission endorse or promote products derived from this software without specific prior written permission
bsd-2-clause 3 spdx spdx license identifier bsd 2 clause
bsd-3-clause 3 spdx spdx license identifier bsd 3 clause
isc 2 licen isc licen[cs]e
isc 3 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 3 spdx spdx license identifier isc
mpl-2.0 3 licen mozilla public license (?:version |v)?2(?: 0)?
mpl-1.1 3 licen mozilla public license (?:version |v)?1 1
mpl-1.0 3 licen mozilla public license (?:version |v)?1 0
mpl 2 licen mozilla public license
mpl-2.0 3 licen subject to the terms of the mozilla public license
mpl-2.0 3 spdx spdx license identifier mpl 2 0
epl-2.0 3 licen eclipse public license (?:version |v)?2(?: 0)?
epl-1.0 3 licen eclipse public license (?:version |v)?1(?: 0)?
epl 2 licen eclipse public license
edl-1.0 2 licen eclipse distribution license
cddl-1.1 3 licen common development and distribution license (?:version |v)?1 1
cddl-1.0 3 licen common development and distribution license (?:version |v)?1 0
cddl 2 licen common development and distribution license
cpl-1.0 2 licen common public license
ipl-1.0 2 licen ibm public license
eupl-1.2 3 licen european union public licen[cs]e (?:version |v)?1 2
eupl-1.1 3 licen european union public licen[cs]e (?:version |v)?1 1
eupl 2 licen european union public licen[cs]e
artistic-2.0 3 licen artistic license (?:version |v)?2(?: 0)?
artistic-1.0 3 licen artistic license (?:version |v)?1(?: 0)?
artistic 2 licen artistic license
bsl-1.0 3 licen boost software license
busl-1.1 3 licen business source license
zlib 2 licen (?:zlib|zlib libpng) licen[cs]e
libpng 2 licen libpng licen[cs]e
unlicense 3 unlicense (?:the )?unlicense
unlicense 3 public domain free and unencumbered software released into the public domain
wtfpl 3 licen do what the fuck you want to public license
postgresql 2 licen postgresql licen[cs]e
python-2.0 2 licen python (?:software foundation )?licen[cs]e
psf 2 licen psf licen[cs]e
ruby 2 licen ruby licen[cs]e
php 2 licen php licen[cs]e
perl 3 perl itself under the same terms (?:of licen[cs]e )?as perl itself
perl 2 terms of the terms of perl itself
openssl 2 licen openssl licen[cs]e
ncsa 2 licen (?:university of illinois )?ncsa (?:open source )?licen[cs]e
afl-3.0 3 licen academic free license (?:version |v)?3(?: 0)?
afl 2 licen academic free license
osl-3.0 3 licen open software license (?:version |v)?3(?: 0)?
osl 2 licen open software license
ofl-1.1 3 licen (?:sil )?open font license (?:version |v)?1 1
ofl 2 licen (?:sil )?open font license
odbl-1.0 3 licen open (?:data commons open )?database license
odc-by 3 licen open data commons attribution license
pddl 3 public domain (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive 3 licen community data license agreement permissive
cdla-sharing 3 licen community data license agreement sharing
ogl-3.0 3 licen open government licen[cs]e (?:version |v)?3(?: 0)?
ogl-2.0 3 licen open government licen[cs]e (?:version |v)?2(?: 0)?
ogl 2 licen open government licen[cs]e
etalab 2 licen licence ouverte
dl-de-by 2 lizenz datenlizenz deutschland namensnennung
cecill 2 cecill (?:cecill|licence cecill)(?: licen[cs]e)?
ms-pl 2 licen microsoft public license
ms-rl 2 licen microsoft reciprocal license
sspl 3 licen server side public license
elastic-2.0 3 licen elastic license (?:version |v)?2(?: 0)?
elastic 2 licen elastic license
polyform 2 licen polyform [a-z]+ license
commons-clause 3 licen commons clause license condition
lppl 2 licen latex project public license
qpl 2 licen q public license
sleepycat 2 licen sleepycat licen[cs]e
vim 2 licen vim licen[cs]e
w3c 2 licen w3c (?:software )?(?:notice and )?licen[cs]e
json 2 licen json licen[cs]e
json 3 good not evil the software shall be used for good not evil
beerware 2 licen beer ?ware licen[cs]e
curl 2 licen curl licen[cs]e
icu 2 licen (?:icu|unicode) licen[cs]e
intel 2 licen intel open source license
ijg 2 licen independent jpeg group licen[cs]e
nasa 2 licen nasa open source agreement license
naist 2 licen naist license
ntp 2 licen ntp licen[cs]e
oracle-upl 2 licen universal permissive license
rpl 2 licen reciprocal public license
sissl 2 licen sun industry standards source license
spl 2 licen sun public license
tcl 2 licen tcl tk licen[cs]e
zope 2 licen zope public license
openrail 2 licen (?:creativeml |bigscience )?open ?rail(?: m| d| s)? licen[cs]e
bloom-rail 3 licen bigscience bloom rail license
llama 2 licen llama (?:[0-9] )?community license(?: agreement)?
gemma 2 terms of gemma terms of use
game-ogl 2 licen open game license
opl 2 licen open (?:publication|content) license
d-fsl 2 lizenz deutsche freie software lizenz
d-fsl 2 licen german free software license
against-drm 2 licen against drm license
free-art 2 licen (?:free art license|licence art libre)
cc0-1.0 3 cc cc ?0 (?:version |v)?1 0(?: universal)?
cc0 2 cc cc ?0(?: public domain dedication)?
cc0 2 creative commons creative commons zero
cc0 3 public domain no rights reserved public domain
cc0 3 rights waived all copyright and related or neighbou?ring rights
cc-sampling 2 creative commons creative commons sampling(?: plus)?
cc-devnations 2 creative commons creative commons developing nations
cc-pdm 2 public domain public domain mark(?: 1 0)?
cc 1 creative commons creative commons(?: licen[cs]e)?
public-domain 2 public domain (?:is |are |placed |released |dedicated |falls )?in(?:to)? the public domain
public-domain 2 public domain dedicated to the public domain
public-domain 1 public domain public domain
us-government 3 public domain work of the (?:u s|us|united states) government (?:and is )?in the public domain
us-government-rights 3 rights u s government (?:users )?restricted rights
reserved 2 rights (?:all )?rights reserved
reserved 3 vorbehalten alle rechte vorbehalten
reserved 3 rights all rights reserved worldwide
reserved 2 rights some rights reserved
no-rights-reserved 2 rights no rights reserved
reserved 3 rights all rights (?:are )?reserved no part of this (?:publication|book|work|site)
copyright 1 copyright copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright 1 copyright (?:c )?copyright (?:by|held by|belongs to|owned by)
copyright 1 copyright (?:is )?protected by (?:international )?copyright(?: law)?s?
copyright-notice 2 copyright the above copyright notice and this permission notice shall be included
copyright-notice 2 copyright copyright notice
copyright-infringement 2 copyright copyright infringement
copyright-holder 1 copyright copyright (?:holder|owner)s?
copyleft 1 copyleft copyleft
fair-use 2 copyright fair use (?:under|of) (?:section 107 of )?(?:the )?copyright(?: act)?
dmca 2 copyright digital millennium copyright act
crown 2 copyright crown copyright
permission-required 2 permission without (?:the )?(?:prior |express |explicit )*(?:written )?permission
permission-required 2 consent without (?:the )?(?:prior |express |explicit )*(?:written )?consent
permission-granted 2 permission (?:used|reprinted|reproduced|republished) (?:with|by) (?:the )?(?:kind )?permission
permission-granted 1 permission permission is (?:hereby )?granted
permission-required 1 permission (?:prior )?written permission (?:is required|from|of)
no-reproduction 2 permission may not be (?:reproduced|copied|published|broadcast|rewritten|transmitted)(?: or [a-z]+)* without (?:prior |written )*permission
no-redistribution 2 redistribut (?:may not be|not to be|do not|no) redistribut(?:ed|e|ion)
redistribution 1 redistribut (?:freely |may be )redistribut(?:ed|e|able)
no-warranty 2 warrant (?:provided )?as is without warranty of any kind(?: express or implied)?
no-warranty 2 warrant without any warranty(?: without even the implied warranty of)?
no-warranty 1 warrant no warrant(?:y|ies)
no-warranty 2 warrant disclaims? all warranties
no-warranty 2 warrant merchantability (?:or|and) fitness for a particular purpose.{0,40} warrant(?:y|ies)
proprietary 2 proprietary proprietary and confidential
proprietary 1 proprietary proprietary (?:information|software|rights|license)
confidential 1 confidential (?:strictly )?confidential(?: information)?
trade-secret 1 trade secret trade secrets?
trade-secret 1 proprietary proprietary secrets?
trademark 1 trademark (?:registered )?trademarks? (?:of|are the property of)
trademark 2 trademark all (?:other )?trademarks are (?:the )?property of their respective owners
terms-of-use 1 terms of (?:subject to |see |our )?(?:the )?terms of (?:use|service)
eula 2 licen end user licen[cs]e agreement
commercial 2 licen commercial licen[cs]e
non-commercial 2 licen non ?commercial (?:use )?licen[cs]e
academic 2 licen academic (?:use )?licen[cs]e
research 2 licen (?:for )?research (?:use |purposes )?only licen[cs]e
dual 2 licen dual licen[cs]ed?
royalty-free 2 licen royalty free(?: perpetual| irrevocable| worldwide| non exclusive)* licen[cs]e
exclusive 2 licen non exclusive licen[cs]e
sublicense 1 licen sublicen[cs](?:e|ed|able)
open-source 2 open source open source (?:software )?licen[cs]e
open-source 1 open source open source
licensed 1 licen licensed under
licensed 1 licen (?:released|distributed|available) under (?:the|a|an)(?: [a-z0-9]+){1,6} licen[cs]e
license-file 2 licen see (?:the )?licen[cs]e (?:file|txt|md)
license-text 1 licen (?:this|the) licen[cs]e
"""


def _parsed() -> list[tuple[str, int, str, str]]:
    out = []
    multi = sorted((r.strip() for r in ROOTS if " " in r.strip()), key=len, reverse=True)
    for line in _HAND.strip().split("\n"):
        label, priority, rest = line.split(" ", 2)
        keyword = next((k for k in multi if rest.startswith(k + " ")), rest.split(" ", 1)[0])
        out.append((label, int(priority), " cc" if keyword == "cc" else keyword, rest[len(keyword) + 1 :]))
    return out


#: (label, priority, keyword, regular expression); the base phrases come first.
RULES = [(label, 3, keyword, phrase) for label, keyword, phrase in BASE] + _creative_commons() + _gnu() + _parsed()
#: Words that say little about which rule may match.
_COMMON = frozenset("licen licens license licence version v under the of or and a as is by for free software public general terms any to in this on with".split())


def plain_runs(rx: str) -> list[str]:
    """The stretches of plain characters that every match of an expression holds."""
    out, run, i = [], "", 0
    while i < len(rx):
        c = rx[i]
        if c == "|":
            return []
        if c in "([":
            depth, close = 0, {"(": ")", "[": "]"}[c]
            for j in range(i, len(rx)):
                depth += (rx[j] == c) - (rx[j] == close)
                if not depth:
                    break
            out, run, i = [*out, run], "", j
        elif c in "?*{":  # what comes before may be missing
            out, run, i = [*out, run[:-1]], "", rx.index("}", i) if c == "{" else i
        elif c in "+.\\^$)":
            out, run = [*out, run], ""
        else:
            run += c
        i += 1
    return [x for x in [*out, run] if x]


def gate(keyword: str, rx: str) -> str:
    """The stretch with the most letters in words of three or more that aren't common ones; the rule's keyword, if none has more."""
    telling = lambda x: (sum(len(w) for w in x.split() if len(w) > 2 and w not in _COMMON), len(x))
    return max([keyword, *plain_runs(rx)], key=telling)


CONFIDENCE = {0: 0.0, 1: 0.3, 2: 0.7, 3: 0.95}
_FOUND = "array<struct<start:int,stop:int,priority:int,rule:int,label:string>>"


def words_joined(text: Column) -> Column:
    """' w1 w2 ... ': the words of [0-9a-z] and non-ASCII characters after lower-casing A-Z, with a space on either side."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), F.lit(" "))
    # lower() turns two characters beyond ASCII into ASCII letters; their rare texts take the exact, slower way
    odd = spaced.contains("K") | spaced.contains("İ")
    lowered = F.when(odd, F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(spaced))
    return F.regexp_replace(lowered, "  +", " ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _detect(joined: Column) -> Column:
    """All rules' places in a text of joined words, as word intervals [start, stop)."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(gate(k, rx)).alias("gate"), F.lit(f"(?<= )({rx})(?= )").alias("rx")) for i, (label, p, k, rx) in enumerate(RULES)])

    def places(r: Column) -> Column:
        marked = F.split(F.regexp_replace(joined, r["rx"], F.lit("\u0001$1\u0002")), F.lit("\u0001"))
        none = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_FOUND).alias("found"))

        def step(acc: Column, piece: Column) -> Column:
            own = F.struct((acc["at"] - 1).alias("start"), (acc["at"] + _spaces(F.substring_index(piece, "\u0002", 1))).alias("stop"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))
            found = F.when(acc["found"].isNull(), F.array().cast(_FOUND)).otherwise(F.concat(acc["found"], F.array(own)))  # the first piece lies before the first place
            return F.struct((acc["at"] + _spaces(piece)).alias("at"), found.alias("found"))

        return F.aggregate(marked, none, step, lambda acc: acc["found"])

    return F.flatten(F.transform(F.filter(rules, lambda r: joined.contains(r["gate"])), places))


def _kept(found: Column) -> Column:
    """Without the intervals contained in one of the same or a higher priority. Ordered by start, longest first, then by
    priority and rule, all containers of an interval come before it: the furthest stop of each priority so far decides."""
    order = F.transform(found, lambda x: F.struct(x["start"].alias("a"), (-x["stop"]).alias("b"), (-x["priority"]).alias("c"), x["rule"].alias("d"), x["label"].alias("e")))
    kind = "array<struct<start:int,stop:int,priority:int,label:string>>"
    none = F.struct(*[F.lit(-1).alias(f"p{p}") for p in (1, 2, 3)], F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        stop, priority = -x["b"], -x["c"]
        furthest = F.when(priority == 3, acc["p3"]).when(priority == 2, F.greatest(acc["p2"], acc["p3"])).otherwise(F.greatest(acc["p1"], acc["p2"], acc["p3"]))
        own = F.array(F.struct(x["a"].alias("start"), stop.alias("stop"), priority.alias("priority"), x["e"].alias("label"))).cast(kind)
        kept = F.when(stop > furthest, F.concat(acc["kept"], own)).otherwise(acc["kept"])
        return F.struct(*[F.when(priority == p, F.greatest(acc[f"p{p}"], stop)).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in (1, 2, 3)], kept.alias("kept"))

    return F.aggregate(F.array_sort(order), none, step, lambda acc: acc["kept"])


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, detections (array of start, stop, priority, label; suppressed ones left out), base (array of all
    places of the base phrases: start, label), labels (distinct, sorted; base labels always among them) and score.

    score: the confidence of the best detection, 0 without one. Null text is empty: no words, empty arrays. Columns of
    df with these names are replaced; repeated rows are scanned each by itself.
    """
    held = df.drop("n_words", "detections", "base", "labels", "score")
    joined, found = unused(held, "_joined", "_found")
    x = held.withColumn(joined, words_joined(F.col(text_col)))
    some = F.lit(False)
    for root in ROOTS:
        some = some | F.col(joined).contains(root)
    x = x.select(*quoted(held.columns), F.greatest(_spaces(F.col(joined)) - 1, F.lit(0)).cast("bigint").alias("n_words"), F.when(some, _detect(F.col(joined))).otherwise(F.array().cast(_FOUND)).alias(found))
    x = x.withColumn("detections", F.when(F.size(found) > 0, _kept(F.col(found))).otherwise(F.array().cast("array<struct<start:int,stop:int,priority:int,label:string>>")))
    x = x.withColumn("base", F.transform(F.filter(found, lambda r: r["rule"] < len(BASE)), lambda r: F.struct(r["start"], r["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("detections", lambda r: r["label"]), F.transform("base", lambda r: r["label"]))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda r: r["priority"])), F.lit(0))
    score = F.element_at(F.array(*[F.lit(CONFIDENCE[p]) for p in range(4)]), best + 1)
    return x.select(*quoted(held.columns), "n_words", "detections", "base", labels.alias("labels"), score.alias("score"))
