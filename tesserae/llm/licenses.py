"""License scans by ordered signature rules, in DataFrame operations only.

A few hundred regexes over the normalised words of a text: sentences of license
texts, headers and notices, identifiers, and license names.  A keyword prefilter
decides which texts are looked at and which rules are tried on each of them.  Of overlapping detections the one
whose word interval contains the other's stays, and of equal intervals the one
of higher priority.

Nulls and odd cases: a null or empty text has no words, no labels and score 0.
Each input row gives one row, repeated rows too (rows are joined by a number
that is stored with them); null ids stay null.  Other columns keep their values;
only the columns that are added take the place of columns of their names.  Texts
are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.storage import boxed, documents, stored, unboxed
from tesserae.llm.textsql import WORD_ANY_CASE, ascii_lower, bound, plain_words, running_sums

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, keyword (a substring of the name's words, lower case), regex of the name's words.
LICENSES = (
    ("gpl", "gnu", "gnu general public license|gnu gpl"),
    ("gpl-3", "gnu", "gnu general public license (?:version |v )?3(?: 0)?(?: or later)?"),
    ("gpl-2", "gnu", "gnu general public license (?:version |v )?2(?: 0)?(?: or later)?"),
    ("lgpl", "lesser", "gnu lesser general public license|lesser gpl"),
    ("agpl", "affero", "gnu affero general public license|affero gpl"),
    ("gfdl", "free documentation", "gnu free documentation license"),
    ("apache-2.0", "apache", "apache license (?:version |v )?2(?: 0)?"),
    ("apache", "apache", "apache license|apache software license"),
    ("mit", "mit licen", "mit licen[cs]e"),
    ("mit", "expat", "the expat licen[cs]e"),
    ("bsd", "bsd", "bsd license|bsd licence"),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: license)?|2 clause bsd(?: license)?|simplified bsd license"),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: license)?|3 clause bsd(?: license)?|new bsd license|modified bsd license"),
    ("bsd-0-clause", "bsd", "zero clause bsd(?: license)?|0bsd"),
    ("mpl", "mozilla", "mozilla public license"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:version |v )?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public license"),
    ("cddl", "common development", "common development and distribution license"),
    ("cpl", "common public", "common public license"),
    ("isc", "isc licen", "isc licen[cs]e"),
    ("zlib", "zlib licen", "zlib licen[cs]e"),
    ("bsl", "boost", "boost software license"),
    ("artistic", "artistic", "artistic license"),
    ("unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql license"),
    ("python", "python software", "python software foundation license"),
    ("python", "psf licen", "psf licen[cs]e"),
    ("php", "php licen", "php licen[cs]e"),
    ("ruby", "ruby licen", "ruby licen[cs]e"),
    ("openssl", "openssl", "openssl license"),
    ("ofl", "open font", "sil open font license"),
    ("odbl", "open database", "open database license"),
    ("eupl", "european union", "european union public licen[cs]e"),
    ("cecill", "cecill", "cecill(?: b| c)?(?: license)?"),
    ("osl", "open software", "open software license"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("vim", "vim licen", "vim licen[cs]e"),
    ("w3c", "w3c", "w3c software notice and license"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license|ncsa license"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative|ativ|s)(?:e?s)?(?: [1-4] 0)?"),
    ("public-domain", "public domain", "public domain"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
)

#: Label, priority out of 100, keyword (stands in every match), regex over lower-case words.  Sentences of license texts, headers and notices.
SIGNATURES = (
    # MIT and its relatives
    ("mit", 96, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 92, "sublicense", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", 88, "permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 70, "warrant", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", 72, "copyright holders", "in no event shall the authors or copyright holders be liable for any claim"),
    ("mit", 85, "licen", "(?:this source code is )?licensed under the mit style license"),
    ("mit", 84, "licen", "may be freely distributed under the mit license"),
    ("mit", 82, "licen", "dual licensed under the mit (?:and|or) (?:the )?(?:gpl|bsd|apache)(?: licenses?)?"),
    ("mit", 90, "licen", "opensource org licenses mit"),
    ("mit", 80, "x11", "x11 licen[cs]e"),
    ("isc", 96, "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 80, "disclaims", "the author disclaims all warranties with regard to this software"),
    ("isc", 90, "licen", "opensource org licenses isc"),
    # BSD
    ("bsd", 90, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 86, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 86, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 94, "endorse", "neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 84, "endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 94, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 70, "copyright holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", 70, "warrant", "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", 88, "bsd", "use of this source code is governed by a bsd style license"),
    ("bsd-3-clause", 90, "bsd", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 90, "bsd", "opensource org licenses bsd 2 clause"),
    # Apache
    ("apache-2.0", 97, "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 90, "licen", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 90, "licen", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 92, "licen", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license"),
    ("apache-2.0", 80, "licen", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 95, "licen", "apache org licenses license 2 0"),
    ("apache-2.0", 95, "licen", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 92, "apache", "this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl", 92, "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", 96, "licen", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", 96, "licen", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", 95, "licen", "gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl", 78, "warrant", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 88, "gnu", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file)"),
    ("gpl", 80, "licen", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 90, "gnu", "gnu org (?:licenses|copyleft) gpl"),
    ("gpl-3", 93, "gnu", "gnu org licenses gpl 3 0"),
    ("gpl-2", 93, "gnu", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl", 76, "copyleft", "the gnu general public license is a free copyleft license for software"),
    ("gpl-3", 86, "gpl", "gplv?3(?: 0)?|gpl (?:v|version )?3(?: 0)?"),
    ("gpl-2", 86, "gpl", "gplv?2(?: 0)?|gpl (?:v|version )?2(?: 0)?"),
    ("lgpl", 93, "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 90, "gnu", "gnu org licenses lgpl"),
    ("lgpl", 84, "lgpl", "lgplv?(?:2 1|3|2)(?: 0)?|lgpl (?:v|version )?(?:2 1|3|2)(?: 0)?"),
    ("lgpl", 80, "gnu", "gnu library general public license"),
    ("agpl", 94, "gnu", "gnu affero general public license as published by the free software foundation"),
    ("agpl", 90, "gnu", "gnu org licenses agpl"),
    ("agpl", 86, "agpl", "agplv?3(?: 0)?|agpl (?:v|version )?3(?: 0)?"),
    ("gfdl", 95, "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 85, "gnu", "gnu fdl|gfdl gnu"),
    ("gpl-with-exception", 90, "gnu", "as a special exception [a-z0-9 ]{1,120} gnu general public license"),
    # Mozilla, Eclipse, Sun, Boost, zlib
    ("mpl-2.0", 96, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 88, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 95, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", 90, "mozilla", "mozilla org mpl"),
    ("epl", 95, "eclipse", "made available under the terms of the eclipse public license"),
    ("epl", 90, "eclipse", "eclipse org legal epl"),
    ("cddl", 95, "common development", "subject to the terms of the common development and distribution license"),
    ("bsl", 97, "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl", 92, "licen", "distributed under the boost software license version 1 0"),
    ("zlib", 92, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", 86, "warrant", "this software is provided as is without any express or implied warranty"),
    ("zlib", 80, "copyright", "altered source versions must be plainly marked as such and must not be misrepresented as (?:being )?the original software [a-z0-9 ]{0,40}copyright"),
    ("libpng", 84, "licen", "libpng licen[cs]e"),
    # Unlicense, public domain, Creative Commons
    ("unlicense", 96, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 88, "licen", "unlicense org"),
    ("public-domain", 84, "public domain", "(?:released|placed|put) (?:in|into) the public domain"),
    ("public-domain", 84, "public domain", "dedicated? [a-z0-9 ]{0,60}to the public domain"),
    ("cc0", 95, "copyright", "to the extent possible under law [a-z0-9 ]{1,80} has waived all copyright and related or neighbou?ring rights"),
    ("cc0", 92, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", 91, "creativecommons", "creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", 92, "creativecommons", "creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nc", 92, "creativecommons", "creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nd", 92, "creativecommons", "creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc-sa", 93, "creativecommons", "creativecommons org licenses by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", 93, "creativecommons", "creativecommons org licenses by nc nd [1-4] [0-9]"),
    ("cc-by-nc-sa", 88, "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?"),
    ("cc-by-nc-nd", 88, "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative|ativ|s)(?:e?s)?(?: [1-4] [0-9])?"),
    ("wtfpl", 92, "public license", "do what the fuck you want to public license"),
    # fonts, languages, products
    ("ofl", 95, "licen", "this font software is licensed under the sil open font license"),
    ("ofl", 80, "reserved font", "with reserved font name"),
    ("php", 92, "licen", "this source file is subject to version [23] [0-9]{1,2} of the php license"),
    ("openssl", 90, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit copyright|openssl toolkit [a-z0-9 ]{0,40}license"),
    ("python", 88, "licen", "psf license agreement for python|python software foundation license version 2"),
    ("ruby", 80, "licen", "same terms as ruby itself see license|distributes under the ruby license"),
    ("perl", 84, "licen", "same terms as perl itself [a-z0-9 ]{0,60}license"),
    ("curl", 80, "licen", "curl licen[cs]e"),
    ("icu", 80, "licen", "icu licen[cs]e"),
    ("unicode", 86, "licen", "unicode inc license agreement data files and software"),
    ("zope", 80, "licen", "zope public license"),
    ("qpl", 80, "licen", "q public license"),
    ("sleepycat", 80, "licen", "sleepycat licen[cs]e"),
    ("ipl", 80, "licen", "ibm public license"),
    ("apsl", 80, "licen", "apple public source license"),
    ("afl", 80, "licen", "academic free license"),
    ("beerware", 86, "beerware", "the beerware license|beerware license revision 42"),
    ("json", 86, "permission notice", "this permission notice shall be included [a-z0-9 ]{0,60}the software shall be used for good not evil"),
    ("blue-oak", 80, "licen", "blue oak model license"),
    ("mulan", 80, "licen", "mulan (?:permissive software license|psl v[12] license)"),
    ("hippocratic", 80, "licen", "hippocratic license"),
    # source available, data and models
    ("sspl", 86, "licen", "server side public license"),
    ("elastic-2.0", 86, "licen", "elastic license (?:2 0|v2)"),
    ("busl", 86, "licen", "business source license(?: 1 1)?"),
    ("commons-clause", 86, "commons", "commons clause license condition|commons clause v1 0"),
    ("polyform", 86, "licen", "polyform (?:noncommercial|small business|shield|strict|perimeter) license"),
    ("ogl", 84, "licen", "open government licen[cs]e"),
    ("odc-by", 84, "licen", "open data commons attribution license"),
    ("pddl", 84, "licen", "public domain dedication and licen[cs]e"),
    ("cdla", 84, "licen", "community data license agreement"),
    ("openrail", 86, "licen", "(?:bigscience|creativeml) (?:bloom )?(?:open ?)?rail(?: ?[ms])? license"),
    ("llama", 84, "licen", "llama (?:2|3|3 1|3 2) community license"),
    # proprietary
    ("proprietary", 84, "prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 82, "proprietary", "proprietary and confidential|confidential and proprietary information of"),
    ("proprietary", 80, "copyright", "no part of this (?:publication|book|document|work) may be reproduced [a-z0-9 ]{0,200}copyright"),
    ("proprietary", 70, "licen", "this software is licensed and not sold|is licensed not sold"),
    ("non-commercial", 74, "licen", "licensed for non ?commercial use only"),
    ("see-license", 66, "licen", "see the license file(?: for (?:details|license rights and limitations|more information))?"),
    ("see-license", 66, "licen", "license that can be found in the license file"),
)

#: Label and identifier, by words, after 'spdx license identifier'.
SPDX = (
    ("gpl-3", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gpl 2 0(?: only| or later)?"),
    ("lgpl", "lgpl [23] [01](?: only| or later)?"),
    ("agpl", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("apache-2.0", "apache 2 0"),
    ("mit", "mit(?: 0)?"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-0-clause", "0bsd"),
    ("isc", "isc"),
    ("mpl-2.0", "mpl 2 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("epl", "epl [12] 0"),
    ("cddl", "cddl 1 [01]"),
    ("bsl", "bsl 1 0"),
    ("zlib", "zlib"),
    ("unlicense", "unlicense"),
    ("cc0", "cc0 1 0"),
    ("cc-by", "cc by [1-4] 0"),
    ("cc-by-sa", "cc by sa [1-4] 0"),
    ("cc-by-nc", "cc by nc [1-4] 0"),
    ("wtfpl", "wtfpl"),
    ("ofl", "ofl 1 1"),
    ("artistic", "artistic [12] 0"),
    ("postgresql", "postgresql"),
    ("python", "psf 2 0|python 2 0"),
    ("ncsa", "ncsa"),
    ("eupl", "eupl 1 [012]"),
    ("elastic-2.0", "elastic 2 0"),
    ("busl", "busl 1 1"),
    ("sspl", "sspl 1 0"),
)

#: Phrase forms with NAME for the names above, and priorities out of 100.
FORMS = (
    ("(?:licensed|released|distributed|published|available|subject to|governed by) (?:under )?(?:the )?(?:terms of (?:the )?)?(?:NAME)(?: (?:version|v) [0-9]+(?: [0-9]+)?)?", 75),
    ("(?:NAME)", 60),
)


@dataclass(frozen=True)
class Rule:
    """keyword stands, as a run of whole or partial words, in every match of regex; regex is over words that each have a space on both sides."""

    rank: int
    label: str
    keyword: str
    regex: str
    priority: int


def rules() -> list[Rule]:
    """All rules, from the highest priority."""
    made = [(p, label, key, regex) for label, p, key, regex in SIGNATURES]
    made += [(98, label, "spdx", f"spdx license identifier (?:{words})") for label, words in SPDX]
    made += [(p, label, key, form.replace("NAME", name)) for form, p in FORMS for label, key, name in LICENSES]
    made.sort(key=lambda x: -x[0])
    return [Rule(rank, label, key, _spaced(regex), p) for rank, (p, label, key, regex) in enumerate(made)]


def _spaced(regex: str) -> str:
    """The regex for a text in which each word has a space on both sides: ' a  b '."""
    doubled = regex.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?")
    return f" (?:{doubled}) "


def rule_table(spark: SparkSession) -> DataFrame:
    """(keyword, rules): the rules of each keyword, a few hundred in all, whatever the input."""
    one = spark.createDataFrame([(r.keyword, (r.rank, r.label, r.priority, r.regex)) for r in rules()], "keyword string, rule struct<rank:int,label:string,priority:int,regex:string>")
    return one.groupBy("keyword").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def normalised(words: Column) -> Column:
    """' a  b  c ': each word with a space on both sides, so that neighbouring matches share none."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


#: One of these, lower case, stands in every match of a base phrase or a rule; "cc by" has its own regex.
GATE_WORDS = (
    "licen", "gpl", "bsd", "cecill", "cc0", "wtfpl", "commons", "domain", "reserved", "gnu", "spdx", "hereby", "redistribut", "warrant", "disclaims",
    "copyright", "endorse", "advertising", "apache", "mozilla", "mpl", "eclipse", "misrepresented", "openssl", "permission", "prohibited", "proprietary",
)
GATE_CC_BY = r"(?i)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def gate(text: Column) -> Column:
    """Whether a text can have a match at all; false for null.  Full lower case never takes an ASCII letter away."""
    lowered = F.lower(text)
    tests = [F.contains(lowered, F.lit(w)) for w in GATE_WORDS] + [text.rlike(GATE_CC_BY)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def detections(gated: DataFrame) -> DataFrame:
    """(_row, label, priority, start, end) of the rules, by words, after suppression.  gated has _row, its own for each text, and _norm.

    A text is taken along once for each keyword that it has.  Within a text,
    ordered by start, then the longer one, then priority, an interval lies in an
    earlier one just when an earlier end reaches its end.
    """
    keys = sorted({r.keyword for r in rules()})
    present = F.filter(F.array(*map(F.lit, keys)), lambda k: F.contains(F.col("_norm"), F.replace(k, F.lit(" "), F.lit("  "))))
    tried = gated.select("_row", "_norm", F.explode_outer(present).alias("keyword")).join(F.broadcast(rule_table(gated.sparkSession)), "keyword")
    # a rule's matches are cut out, and the words before a place are half the spaces before it
    count = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")

    def intervals(r: Column) -> Column:
        found = F.regexp_extract_all("_norm", r["regex"], F.lit(0))

        def placed(f: Column) -> Column:
            steps = F.zip_with(f, F.slice(F.split("_norm", r["regex"], -1), F.lit(1), F.size(f)), lambda m, gap: count(m) + count(gap))
            return F.zip_with(f, running_sums(steps), lambda m, end: F.struct(r["rank"].alias("rank"), r["label"].alias("label"), r["priority"].alias("priority"), (end - count(m)).alias("start"), end.alias("end")))

        return F.when(F.rlike(F.col("_norm"), r["regex"]), bound(found, placed))

    # of an inner explode the optimizer would derive a filter that tries all rules a second time
    each = tried.select("_row", F.explode_outer(F.flatten(F.array_compact(F.transform("rules", intervals)))).alias("x"))
    spans = each.filter(F.col("x").isNotNull()).select("_row", "x.*")
    before = W.partitionBy("_row").orderBy("start", F.desc("end"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("end").over(before)).filter("reach is null or reach < end").drop("reach", "rank")


def _base_places(words: Column) -> Column:
    """array<struct<at,label>>: where base phrases stand."""
    tests = [(phrase.split(" "), label) for phrase, label in BASE_PHRASES.items()]

    def stands(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for parts, label in tests:
            out = F.when(reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)]), F.lit(label)).otherwise(out)
        return out

    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), stands(i).alias("label"))), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, with n_words, n_base, first_word, last_word, base_labels and labels (arrays), score.

    One pass over the texts counts words and, for those that the gate lets
    through, finds base phrases and keeps the normalised words.  It is stored
    with a number for each row; the rules are tried on the kept words, and only
    labels are joined back.
    """
    columns = [c for c in docs.columns if c != text_col]
    text, words = F.col("_text"), F.col("_words")
    base = docs.select(boxed(columns), F.col(text_col).alias("_text")).select(
        "_box",
        F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
        F.when(gate(text), plain_words(ascii_lower(text))).alias("_words"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = base.withColumns({"_norm": normalised(words), "_places": F.coalesce(_base_places(words), F.expr("cast(array() as array<struct<at:int,label:string>>)"))})
    base = base.withColumns(
        {
            "n_base": F.size("_places").cast("long"),
            "first_word": F.get("_places", F.lit(0))["at"].cast("long"),
            "last_word": F.get("_places", F.size("_places") - 1)["at"].cast("long"),
            "base_labels": F.sort_array(F.array_distinct(F.col("_places.label"))),
        }
    ).drop("_words", "_places")
    base = stored(base, "license-texts")
    of = (
        detections(base.filter(F.col("_norm").isNotNull()).select("_row", "_norm"))
        .groupBy("_row")
        .agg(F.collect_set("label").alias("_own"), F.max("priority").alias("_best"))
    )
    out = base.drop("_norm").join(of, "_row", "left")
    return unboxed(
        out,
        columns,
        **{c: c for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")},
        labels=F.sort_array(F.array_distinct(F.concat("base_labels", F.coalesce("_own", F.expr("cast(array() as array<string>)"))))),
        score=F.greatest(F.coalesce(F.col("_best") / 100, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def _oracle() -> str:
    """The same rules, each tried on every text with its keyword, in DuckDB."""
    values = ",\n      ".join(f"({r.rank}, '{r.label}', '{r.keyword}', '{r.regex}', {r.priority})" for r in rules())
    norm = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM places WHERE " + " AND ".join(f"ws[i+{k}] = '{p}'" if k else f"ws[i] = '{p}'" for k, p in enumerate(phrase.split(" "))) for phrase, label in BASE_PHRASES.items()
    )
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    return f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({norm}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    places AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM src),
    base AS ({base}),
    pb AS (SELECT rid, count(*) AS n, min(pos) AS f, max(pos) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM base GROUP BY rid),
    rule(rank, label, keyword, regex, priority) AS (VALUES {values}),
    norm AS (SELECT rid, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM src WHERE len(ws) > 0),
    tried AS (SELECT rid, rank, label, priority, regexp_extract_all(t, regex) AS ms, string_split_regex(t, regex) AS gs FROM norm JOIN rule ON contains(t, replace(keyword, ' ', '  ')) WHERE regexp_matches(t, regex)),
    each AS (SELECT rid, rank, label, priority, list_sum(list_transform(gs[1:i], lambda x: {spaces('x')})) + list_sum(list_transform(ms[1:i], lambda x: {spaces('x')})) AS e, {spaces('ms[i]')} AS n
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM tried)),
    kept AS (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY e - n, e DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM each),
    own AS (SELECT rid, label, priority FROM kept WHERE reach IS NULL OR reach < e),
    po AS (SELECT rid, max(priority) AS best FROM own GROUP BY rid),
    pl AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT rid, label FROM own UNION ALL SELECT rid, label FROM base) GROUP BY rid)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(pb.n, 0) AS BIGINT) AS n_base, CAST(pb.f AS BIGINT) AS first_word, CAST(pb.l AS BIGINT) AS last_word,
      coalesce(pb.ls, '') AS base_labels, coalesce(pl.ls, '') AS labels, CAST(greatest(coalesce(best, 0) / 100, CASE WHEN pb.n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
    FROM src LEFT JOIN pb USING (rid) LEFT JOIN po USING (rid) LEFT JOIN pl USING (rid)"""


ORACLE = _oracle()
