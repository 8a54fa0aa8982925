"""License scans (3): sentence-rule recognition, DataFrame functions only.

A text is cut into sentences and looked up among known licence sentences, in
normal form (ASCII lower case, every run of other characters one space).  Leaders
of comment lines are stripped; sentences end at full stops, semicolons, question
and exclamation marks, and blank lines.  A line's end and a colon are soft: a
known sentence may begin or end there, or run over them, as licence texts are
wrapped.  Lead-ins ("This project is") and verbs are brought to one form.
The identifiers met, in text order, form a sequence; a rule is an ordered list
of identifiers, found when they occur in this order (others may lie between).

Everything happens inside one row: no shuffle.  Known sentences and rules are
fixed tables in the plan, not data.

Cases: null text has no sentences; a licence stated twice is reported once;
repeated rows are scanned alike; a very long text is scanned whole; an empty
table gives no rows; only doc_id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences (as normalised) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheV2",
    "licensed under the apache license version 2 0 the license": "ApacheV2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "spdx license identifier apache 2 0": "SpdxApache",
    "released under the mit license": "MitName",
    "licensed under the mit license": "MitName",
    "this software is released under the mit license": "MitName",
    "the mit license mit": "MitTitle",
    "mit license": "MitTitle",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "MitWarranty",
    "spdx license identifier mit": "SpdxMit",
    "this work is licensed under the gnu general public license version 3": "Gpl3Name",
    "this program is licensed under the gnu general public license version 3": "Gpl3Name",
    "licensed under the gnu general public license version 3": "Gpl3Name",
    "licensed under the gnu general public license version 2": "Gpl2Name",
    "either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is free software": "GplFree",
    "this program is distributed in the hope that it will be useful": "GplHope",
    "spdx license identifier gpl 3 0 only": "SpdxGpl3",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by 4 0": "CcBy4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "redistributions of source code must retain the above copyright notice": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice": "BsdBinary",
    "all rights reserved": "AllRights",
}
# Ordered rules, the more specific ones first.
RULES = (
    ("Apache-2.0", "header", ("ApacheV2", "ApacheComply", "ApacheCopy")),
    ("Apache-2.0", "name", ("ApacheV2",)),
    ("Apache-2.0", "spdx", ("SpdxApache",)),
    ("MIT", "full text", ("MitTitle", "MitNotice", "MitWarranty")),
    ("MIT", "name", ("MitName",)),
    ("MIT", "spdx", ("SpdxMit",)),
    ("GPL-3.0", "header", ("GplFree", "Gpl3OrLater", "GplHope")),
    ("GPL-3.0", "name", ("Gpl3Name",)),
    ("GPL-3.0", "spdx", ("SpdxGpl3",)),
    ("GPL-2.0", "name", ("Gpl2Name",)),
    ("CC-BY-NC-4.0", "name", ("CcByNc4",)),
    ("CC-BY-SA-4.0", "name", ("CcBySa4",)),
    ("CC-BY-4.0", "name", ("CcBy4",)),
    ("BSD", "conditions", ("BsdSource", "BsdBinary")),
    ("Proprietary", "reserved", ("AllRights",)),
)

# Further sentences, as the licence texts have them in full, and
# common variants of the names.
_NAMES = {
    "ApacheV2": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "MitName": ("mit license", "mit licence"),
    "Gpl3Name": ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3",
                 "gnu gpl v3", "gnu gplv3", "gplv3", "gplv3 license", "gpl 3 0 license"),
    "Gpl2Name": ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2",
                 "gnu gpl v2", "gnu gplv2", "gplv2", "gplv2 license", "gpl 2 0 license"),
    "CcByNc4": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CcBySa4": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CcBy4": ("cc by 4 0", "creative commons attribution 4 0 international license"),
}
_NOTICE = "redistributions {} the above copyright notice this list of conditions and the following disclaimer"
VARIANTS = {
    **{f"licensed under {the}{name}": i for i, names in _NAMES.items() for name in names for the in ("", "the ", "a ")},
    "licensed under the apache license version 2 0 the license": "ApacheV2",
    "the mit license": "MitTitle",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "spdx license identifier gpl 3 0 or later": "SpdxGpl3",
    "spdx license identifier gpl 3 0": "SpdxGpl3",
    _NOTICE.format("of source code must retain"): "BsdSource",
    _NOTICE.format("in binary form must reproduce") + " in the documentation and or other materials provided with the distribution": "BsdBinary",
}
# The forms that the lead-ins and verbs below are brought to.
_LEAD = "(?:this|the|our)[ \2](?:[a-z]+[ \2])?[a-z]+[ \2](?:is|are)[ \2]"
_VERB = "(?:licensed|released|distributed|published|available|made[ \2]available)[ \2]under(?:[ \2]the[ \2]terms[ \2]of)?"
_TAIL = "[ \2]see[ \2](?:the[ \2])?(?:license|licence|copying)[a-z0-9 \2]*"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\1\2", "abcdefghijklmnopqrstuvwxyz  "
# Every known sentence holds one of these.
MARKS = "licen|software|redistribution|reserved|useful|gpl"


def known_sentences() -> dict[str, str]:
    """Known sentences, with the lead-in and verb of names in one form."""
    return {re.sub(f"^(?:{_LEAD})?{_VERB}", "licensed under", k): i
            for table in (SENTENCES, VARIANTS) for k, i in table.items()}


# Cuts and joints of the normal form, in order.
CUTS = (("(?m)^[ \t]*(?:[#*/;%>|-]+|<!--+|dnl\\b|rem\\b)[ \t]*", ""),
        ("[.;:!?]*[.;!?]:*[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*", "\1"), (":+[ \t\r\n]+|\n", "\2"),
        ("[^a-z0-9\1\2]+", " "), ("[ \2]*\1[ \1\2]*", "\1"), (" ?\2[ \2]*", "\2"), ("^ | $", ""))


def marked(text: Column) -> Column:
    """The words of a text in normal form, parted by \\1 where a sentence ends, \\2
    where a line does or after a colon, else by a space.  Texts without a mark
    are empty."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.when(F.rlike(t, F.lit(MARKS)), t).otherwise("")
    for pattern, by in (*CUTS, (f"(?<![a-z0-9 ])(?:{_LEAD})?{_VERB}(?=[ \2])", "licensed under"),
                        (f"(?<=licen[cs]e|[0-9]){_TAIL}", "")):
        t = F.regexp_replace(t, pattern, by)
    return t


def known_identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known_sentences()
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    longest = sorted(known, key=lambda k: (-len(k), k))
    pattern = "(?<![a-z0-9 ])(?:" + "|".join(k.replace(" ", "[ \2]") for k in longest) + ")(?![a-z0-9 ])"
    met = F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0))
    return F.transform(met, lambda s: F.element_at(table, F.translate(s, "\2", " ")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Operator 3: doc_id, n_known, sequence (identifiers by comma), licenses
    (names by comma, in rule order; empty: none) and rules (rule by comma)."""
    wrapped = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    found = [F.when(F.col("w").like("%" + "%".join(f",{i}," for i in ids) + "%"),
                    F.struct(F.lit(name).alias("name"), F.lit(f"{name} {rule}").alias("rule")))
             for name, rule, ids in RULES]
    return (docs.select("doc_id", known_identifiers(F.col("text")).alias("ids"))
            .withColumn("w", wrapped)
            .withColumn("hits", F.filter(F.array(*found), lambda x: x.isNotNull()))
            .select("doc_id", F.size("ids").cast("long").alias("n_known"),
                    F.array_join("ids", ",").alias("sequence"),
                    F.array_join(F.array_distinct(F.transform("hits", lambda x: x["name"])), ",").alias("licenses"),
                    F.array_join(F.transform("hits", lambda x: x["rule"]), ",").alias("rules")))
