"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over the words from its keyword on. Words of a text that aren't keywords cost one look-up
in a hash set; only at a keyword the next words, as many as its longest rule can take, are put together and the rules of
that keyword alone are tried, each with a literal pattern. A detection that lies inside a stronger one (higher priority,
then longer, then the earlier rule) is dropped; places are in their order, so it is compared only with those that begin
at most a longest rule before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import split_words

# The phrases that are always reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels that let a text be shared; others restrict it.
OPEN = r"^(mit|bsd|0bsd|apache|cc0|cc-by(?!-n)|isc|zlib|boost|unlicense|public-domain|mpl|psf|ofl|wtfpl|artistic|epl|eupl|gpl|lgpl|agpl|gfdl|cpl|cddl|perl|php|ruby|openssl|ssleay|postgresql|vim|beerware|curl|x11|icu|unicode|ms-pl|ms-rl|cecill|mulan-psl|w3c|ntp|hpnd|fair|lppl|qpl|afl|osl|ncsa|upl|blueoak|naist|sleepycat|odbl|odc-by|pddl|ogl|cdla|creative-commons)"


def _rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regex from the keyword on, label, priority); a rule that names a version outranks one that doesn't."""
    rules: list[tuple[str, str, str, int]] = []

    def add(keyword: str, rest: str, label: str, priority: int) -> None:
        rules.append((keyword, f"^{keyword}{rest}(?= |$)", label, priority))

    either = "(?: version| v)?"  # and "v2" is one word
    gnu = {"gpl": "", "lgpl": "lesser ", "agpl": "affero "}
    for short, kind in gnu.items():
        for version in ("1", "2", "2 1", "3"):
            named, number = f"{short}-{version.replace(' ', '.')}", version + ("(?: 0)?" if " " not in version else "")
            for suffix, later in (("-or-later", " or(?: at your option)?(?: any)? later(?: version)?"), ("-only", " only"), ("", "")):
                add(kind.split()[0] if kind else "general", f"{' general' if kind else ''} public license{either} v?{number}{later}", named + suffix, 3)
                add("gnu", f" {kind}general public license{either} v?{number}{later}", named + suffix, 4)
                add(short, f"(?: licen[cs]e)?{either} v?{number}{later}", named + suffix, 3)
                if " " not in version:
                    add(f"{short}v{version}", later, named + suffix, 3)
        add("gnu", f" {kind}general public license", short, 2)
        add("gnu", f" {short}", short, 2)
        if kind:
            add(kind.strip(), " general public license", short, 2)
    add("library", " general public license", "lgpl", 2)
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
    for terms in (["by"], ["by", "sa"], ["by", "nc"], ["by", "nd"], ["by", "nc", "sa"], ["by", "nc", "nd"]):
        label = "cc-" + "-".join(terms)
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add("cc", f" {' '.join(terms)}{either} v?{version}", f"{label}-{version.replace(' ', '.')}", 4)
            add("creative", f" commons {' '.join(parts[t] for t in terms)}(?: license)?{either} v?{version}", f"{label}-{version.replace(' ', '.')}", 4)
            add("creativecommons", f" org licenses {' '.join(terms)} {version}", f"{label}-{version.replace(' ', '.')}", 4)
        add("cc", f" {' '.join(terms)}", label, 3)
        add("creative", f" commons {' '.join(parts[t] for t in terms)}", label, 3)
    add("cc0", "(?: 1 0)?(?: universal)?", "cc0", 3)
    add("creative", " commons", "creative-commons", 1)
    versioned = {
        "apache": ("software ", ("1 0", "1 1", "2 0")),
        "mozilla": ("public ", ("1 0", "1 1", "2 0")),
        "eclipse": ("public ", ("1 0", "2 0")),
        "artistic": ("", ("1 0", "2 0")),
        "boost": ("software ", ("1 0",)),
        "european": ("union public ", ("1 0", "1 1", "1 2")),
        "academic": ("free ", ("2 0", "2 1", "3 0")),
        "open": ("software ", ("1 0", "2 0", "3 0")),
    }
    names = {"mozilla": "mpl", "eclipse": "epl", "european": "eupl", "academic": "afl", "open": "osl"}
    for first, (middle, versions) in versioned.items():
        label = names.get(first, first)
        for version in versions:
            dotted = version.replace(" ", ".")
            add(first, f" (?:{middle})?licen[cs]e{either} v?{version.removesuffix(' 0')}(?: 0)?", f"{label}-{dotted}", 3)
            add(first, f"{either} v?{version}", f"{label}-{dotted}", 2)
            if label != first:
                add(label, f"{either} v?{version.removesuffix(' 0')}(?: 0)?", f"{label}-{dotted}", 3)
        add(first, f" (?:{middle})?licen[cs]e", label, 2)
    for n, words in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add("bsd", f" {n} clause", f"bsd-{n}-clause", 3)
        add(n, " clause bsd", f"bsd-{n}-clause", 3)
        add(words, " clause bsd", f"bsd-{n}-clause", 3)
    for name in ("mit", "bsd", "isc", "zlib", "psf", "wtfpl", "x11", "ms pl", "ms rl", "cddl", "cecill", "ofl"):
        first, _, rest = name.partition(" ")
        add(first, f"{' ' + rest if rest else ''}(?: style)? licen[cs]e", name.replace(" ", "-"), 2)
        add("licensed", f" under(?: the)?(?: terms of the)? {name}(?: licen[cs]e)?", name.replace(" ", "-"), 3)
        add("license", f" {name}", name.replace(" ", "-"), 2)
        add("spdx", f" license identifier {name}", name.replace(" ", "-"), 4)
    for line in SIGNATURES.strip().splitlines():
        label, priority, pattern = line.split(maxsplit=2)
        keyword = re.match(r"\w+", pattern)[0]
        add(keyword, pattern[len(keyword) :], label, int(priority))
    return rules


#: What licences and notices say, by hand: label, priority, words as they are split here. The first word is the keyword.
SIGNATURES = r"""
mit 3 permission is hereby granted free of charge to any person
mit 2 software is provided as is without warranty of any kind express or implied
mit 2 above copyright notice and this permission notice shall be included in all
mit 2 deal in the software without restriction including without limitation the rights
mit 2 event shall the authors or copyright holders be liable for any claim
mit 3 released under the mit licen[cs]e
mit 3 distributed under the mit licen[cs]e
mit 3 license mit
isc 3 permission to use copy modify and(?: or)? distribute this software(?: for any purpose)?
isc 2 software is provided as is and the author disclaims all warranties
isc 2 event shall the author be liable for any special direct indirect
bsd 3 redistribution and use in source and binary forms
bsd 2 redistributions of source code must retain
bsd 2 redistributions in binary form must reproduce the above copyright notice
bsd-3-clause 3 neither the name of (?:[a-z0-9]+ ){1,6}nor the names of its contributors
bsd-4-clause 3 advertising materials mentioning features or use of this software
bsd 2 software is provided by the copyright holders and contributors as is
bsd 3 released under the (?:new |modified |simplified )?bsd licen[cs]e
apache-2.0 3 licensed under the apache license(?: version 2 0)?
apache-2.0 3 use this file except in compliance with the license
apache-2.0 3 apache org licenses license 2 0
apache-2.0 2 unless required by applicable law or agreed to in writing software distributed
apache-2.0 2 distributed on an as is basis without warranties or conditions of any kind
apache-2.0 2 subject to the terms and conditions of this license each contributor hereby grants
apache-1.1 3 product includes software developed by the apache software foundation
gpl 2 everyone is permitted to copy and distribute verbatim
gpl 3 redistribute it and or modify it under the terms of the gnu general public license
gpl 2 free software foundation either version [0-9]+
gpl 2 without any warranty without even the implied warranty of merchantability
gpl 2 received a copy of the gnu general public license
gpl 2 program is free software you can redistribute it
gpl 2 gnu general public license for more details
gpl 3 gnu org licenses gpl
gpl 3 gnu org copyleft gpl
lgpl 3 gnu org licenses lgpl
lgpl 3 received a copy of the gnu lesser general public license
lgpl 3 received a copy of the gnu library general public license
lgpl 2 library is free software you can redistribute it
agpl 3 received a copy of the gnu affero general public license
agpl 3 gnu org licenses agpl
agpl 2 remote network interaction use with the gnu general public license
gfdl 3 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 3 gnu free documentation licen[cs]e
gfdl 3 invariant sections no front cover texts and no back cover texts
mpl 3 source code form is subject to the terms of the mozilla public license
mpl-1.1 3 contents of this file are subject to the mozilla public license version 1 1
mpl 3 copy of the mpl was not distributed with this file you can obtain one
mpl 3 mozilla org mpl
epl 3 program and the accompanying materials are made available under the terms of the eclipse public license
epl 3 eclipse org legal epl
cpl 3 common public licen[cs]e(?: version)?(?: 1 0)?
cddl 3 common development and distribution licen[cs]e
cddl 3 contents of this file are subject to the terms of the common development and distribution license
ofl 3 font software is licensed under the sil open font license
ofl 3 scripts sil org ofl
ofl 2 sil open font licen[cs]e
ofl 2 reserved font name
zlib 3 software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 2 altered source versions must be plainly marked as such
zlib 2 origin of this software must not be misrepresented
zlib 2 notice may not be removed or altered from any source distribution
boost-1.0 3 distributed under the boost software license
boost-1.0 3 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost-1.0 3 boost org license 1 0 txt
unlicense 3 unencumbered software released into the public domain
unlicense 3 free and unencumbered software
unlicense 2 unlicense
unlicense 3 unlicense org
wtfpl 3 what the fuck you want to public license
wtfpl 3 everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
artistic 3 artistic licen[cs]e
artistic 2 package is free software you can redistribute it and or modify it under the same terms as perl
perl 3 same terms as perl itself
psf 3 python software foundation licen[cs]e
psf 3 psf licen[cs]e agreement
php 3 php licen[cs]e(?: version)?(?: 3 01)?
php 3 product includes php software freely available from
ruby 3 same terms as ruby itself
ruby 3 under the ruby licen[cs]e
openssl 3 product includes software developed by the openssl project
openssl 3 openssl licen[cs]e
ssleay 3 product includes cryptographic software written by eric young
postgresql 3 postgresql licen[cs]e
vim 3 vim licen[cs]e
beerware 3 beer ware licen[cs]e
beerware 3 buy me a beer in return
curl 3 curl licen[cs]e
x11 3 x11 licen[cs]e
x11 2 except as contained in this notice the name of
icu 3 icu licen[cs]e
unicode 3 unicode data files and software
json 3 software shall be used for good not evil
ms-pl 3 microsoft public licen[cs]e
ms-rl 3 microsoft reciprocal licen[cs]e
eupl 3 licensed under the eupl
cecill 3 governed by the cecill(?: [abc])? licen[cs]e
mulan-psl 3 mulan psl v2
w3c 3 w3c software (?:notice and )?licen[cs]e
ntp 3 permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
hpnd 3 historical permission notice and disclaimer
fair 3 usage of the works is permitted provided that this instrument is retained
odbl 3 open data commons open database licen[cs]e
odbl 3 open database licen[cs]e
odc-by 3 open data commons attribution licen[cs]e
pddl 3 public domain dedication and licen[cs]e
ogl 3 open government licen[cs]e
ogl 3 contains public sector information licensed under the open government licence
cdla 3 community data licen[cs]e agreement
cc0 3 creative commons zero
cc0 3 cc0 public domain dedication
cc0 3 creativecommons org publicdomain zero
cc0 2 extent possible under law the (?:author|person|owner)
cc-by 3 work is licensed under a creative commons attribution(?: [0-9] [0-9])?(?: international| unported)? license
cc-by-sa 4 work is licensed under a creative commons attribution share ?alike
cc-by-nc 4 work is licensed under a creative commons attribution non ?commercial
cc-by-nd 4 work is licensed under a creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa 3 available under the creative commons attribution share ?alike licen[cs]e
public-domain 1 public domain
public-domain 2 released (?:in)?to the public domain
public-domain 2 placed in the public domain
public-domain 2 dedicated to the public domain
public-domain 2 known copyright restrictions
public-domain 2 work is in the public domain
reserved 2 all rights reserved
reserved 2 alle rechte vorbehalten
reserved 2 tous droits reserves
reserved 2 todos los derechos reservados
reserved 2 tutti i diritti riservati
proprietary 2 proprietary and confidential
proprietary 2 confidential and proprietary
proprietary 2 unauthorized (?:copying|reproduction|distribution|use)
proprietary 3 unauthorized copying of this file via any medium is strictly prohibited
proprietary 3 part of this (?:publication|book|work|document) may be reproduced
proprietary 3 reproduced without (?:prior |express |the )?(?:written )?(?:permission|consent)
proprietary 2 reproduction (?:is )?(?:strictly )?prohibited
proprietary 2 trade secrets? of
proprietary 3 end user licen[cs]e agreement
proprietary 3 reverse engineer decompile or disassemble
proprietary 2 licensed not sold
proprietary 2 commercial licen[cs]e
proprietary 2 internal use only
personal-use 1 personal use only
personal-use 2 personal and non ?commercial use
non-commercial 1 non commercial use only
non-commercial 2 commercial use (?:is )?(?:not permitted|prohibited)
non-commercial 2 academic (?:purposes|use) only
no-ai 3 training (?:of )?(?:ai|artificial intelligence|machine learning)(?: models?)? (?:is )?(?:not permitted|prohibited)
no-ai 3 mining (?:is )?(?:not permitted|reserved|prohibited)
copyright 1 copyright(?: c)? [0-9]{4}
copyright 2 used (?:by|with) permission
copyright 2 reprinted (?:by|with) permission
mit 4 spdx license identifier mit
mit 3 opensource org licenses mit
mit 3 mit licensed
mit 2 dual licensed under the mit
mit-0 3 mit no attribution
mit-0 4 spdx license identifier mit 0
isc 3 opensource org licenses isc
isc 3 licensed under isc
0bsd 4 spdx license identifier 0bsd
0bsd 3 bsd zero clause
bsd-2-clause 4 spdx license identifier bsd 2 clause
bsd-3-clause 4 spdx license identifier bsd 3 clause
bsd-3-clause 3 opensource org licenses bsd 3 clause
bsd-2-clause 3 opensource org licenses bsd 2 clause
bsd-3-clause 3 new bsd licen[cs]e
bsd-2-clause 3 simplified bsd licen[cs]e
bsd-2-clause 3 freebsd licen[cs]e
bsd-3-clause 3 revised bsd licen[cs]e
bsd 2 bsd style licen[cs]e that can be found in the license file
bsd 2 governed by a bsd style license
bsd 3 use of this source code is governed by a bsd
apache-2.0 4 spdx license identifier apache 2 0
apache-2.0 3 apache org licenses license 2 0 txt
apache-2.0 3 licensed to the apache software foundation
apache-2.0 3 alv2
apache-2.0 2 grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 3 opensource org licenses apache 2 0
apache-1.0 3 developed by the apache group for use in the apache http server project
gpl-2.0-only 4 spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later 4 spdx license identifier gpl 2 0 or later
gpl-3.0-only 4 spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later 4 spdx license identifier gpl 3 0 or later
lgpl-2.1-only 4 spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later 4 spdx license identifier lgpl 2 1 or later
lgpl-3.0-only 4 spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later 4 spdx license identifier lgpl 3 0 or later
agpl-3.0-only 4 spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later 4 spdx license identifier agpl 3 0 or later
gpl 3 opensource org licenses gpl
gpl 2 licensed under (?:the )?gpl
gpl 2 distributed under (?:the )?gpl
gpl 2 released under (?:the )?gpl
gpl 2 gpl compatible
gpl 2 gpl licen[cs]ed
gpl 2 gpl licen[cs]e
lgpl 2 lgpl licen[cs]e
agpl 2 agpl licen[cs]e
gpl 3 classpath exception to the gpl
gpl 3 as a special exception the copyright holders of this library give you permission to link
gpl 3 free software foundation inc 51 franklin street
gpl 3 free software foundation inc 59 temple place
gpl 3 write to the free software foundation
gpl 2 terms of the gnu general public license as published by the free software foundation
lgpl 2 terms of the gnu lesser general public license as published by the free software foundation
agpl 2 terms of the gnu affero general public license as published by the free software foundation
gfdl-1.3 4 spdx license identifier gfdl 1 3
gfdl 3 gnu org licenses fdl
mpl-2.0 4 spdx license identifier mpl 2 0
mpl-1.1 4 spdx license identifier mpl 1 1
mpl-2.0 3 subject to the terms of the mozilla public license v 2 0
mpl-2.0 3 subject to the terms of the mozilla public license v2 0
mpl 2 licensed under (?:the )?mpl
epl-2.0 4 spdx license identifier epl 2 0
epl-1.0 4 spdx license identifier epl 1 0
epl 3 eclipse org org documents epl
cddl-1.0 4 spdx license identifier cddl 1 0
cpl-1.0 4 spdx license identifier cpl 1 0
boost-1.0 4 spdx license identifier bsl 1 0
boost-1.0 3 bsl 1 0
zlib 4 spdx license identifier zlib
zlib 3 zlib libpng licen[cs]e
zlib 3 libpng licen[cs]e
unlicense 4 spdx license identifier unlicense
unlicense 2 anyone is free to copy modify publish use compile sell or distribute this software
wtfpl 4 spdx license identifier wtfpl
artistic-2.0 4 spdx license identifier artistic 2 0
artistic-1.0 4 spdx license identifier artistic 1 0
psf 4 spdx license identifier psf 2 0
psf 3 psf hereby grants licensee a nonexclusive royalty free world wide license
php 4 spdx license identifier php 3 01
ruby 4 spdx license identifier ruby
openssl 4 spdx license identifier openssl
postgresql 4 spdx license identifier postgresql
postgresql 2 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
curl 4 spdx license identifier curl
x11 4 spdx license identifier x11
icu 4 spdx license identifier icu
unicode 4 spdx license identifier unicode
unicode 3 unicode licen[cs]e v3
json 4 spdx license identifier json
ms-pl 4 spdx license identifier ms pl
ms-rl 4 spdx license identifier ms rl
eupl-1.2 4 spdx license identifier eupl 1 2
eupl 3 european union public licen[cs]e
cecill 4 spdx license identifier cecill
ntp 4 spdx license identifier ntp
hpnd 4 spdx license identifier hpnd
w3c 4 spdx license identifier w3c
ofl-1.1 4 spdx license identifier ofl 1 1
odbl-1.0 4 spdx license identifier odbl 1 0
odbl 3 opendatacommons org licenses odbl
odc-by 3 opendatacommons org licenses by
pddl 3 opendatacommons org licenses pddl
cc0 4 spdx license identifier cc0 1 0
cc-by-4.0 4 spdx license identifier cc by 4 0
cc-by-sa-4.0 4 spdx license identifier cc by sa 4 0
cc-by-nc-4.0 4 spdx license identifier cc by nc 4 0
cc-by-nd-4.0 4 spdx license identifier cc by nd 4 0
cc-by-sa 3 text is available under the creative commons attribution share ?alike
cc-by 2 unless otherwise noted this (?:work|content) is licensed under a creative commons attribution
cc-by 3 licensed under cc by
cc-by-sa 4 licensed under cc by sa
cc-by-nc 4 licensed under cc by nc
cc-by-nd 4 licensed under cc by nd
cc0 3 no rights reserved
cc0 3 waived all copyright and related or neighboring rights
public-domain 2 public domain mark
public-domain 2 gemeinfrei
public-domain 2 domaine public
public-domain 2 dominio publico
creative-commons 2 licence creative commons
creative-commons 2 licencia creative commons
creative-commons 2 creative commons lizenz
creative-commons 2 some rights reserved
lppl 3 latex project public licen[cs]e
lppl 4 spdx license identifier lppl
qpl 3 q public licen[cs]e
sleepycat 3 sleepycat licen[cs]e
afl 3 academic free licen[cs]e
osl 3 open software licen[cs]e
busl 3 business source licen[cs]e
busl 4 spdx license identifier busl 1 1
sspl 3 server side public licen[cs]e
sspl 4 spdx license identifier sspl 1 0
elastic 3 elastic licen[cs]e
commons-clause 3 commons clause licen[cs]e
commons-clause 3 commons clause condition
polyform 3 polyform (?:noncommercial|strict|shield|perimeter) licen[cs]e
openrail 3 openrail m? ?licen[cs]e
openrail 3 bigscience rail licen[cs]e
llama 3 llama (?:2|3) community licen[cs]e
aladdin 3 aladdin free public licen[cs]e
naist 3 naist licen[cs]e
ncsa 3 university of illinois ncsa open source licen[cs]e
ncsa 4 spdx license identifier ncsa
upl 3 universal permissive licen[cs]e
upl 4 spdx license identifier upl 1 0
blueoak 3 blue oak model licen[cs]e
reserved 2 tutti i diritti sono riservati
reserved 2 todos os direitos reservados
reserved 2 alle rechten voorbehouden
reserved 2 rights reserved worldwide
proprietary 2 may not be (?:copied|reproduced|redistributed|published)
proprietary 2 may not be reproduced distributed or transmitted
proprietary 2 strictly confidential
proprietary 2 no unauthorized (?:copying|reproduction|distribution|use)
proprietary 2 nachdruck verboten
proprietary 2 toute reproduction interdite
proprietary 2 prohibida su reproduccion
proprietary 3 subject to the terms of a license agreement
proprietary 3 licensed materials property of
personal-use 2 for private use only
personal-use 2 individual personal use
non-commercial 2 not for commercial use
non-commercial 2 nur fuer nicht kommerzielle zwecke
non-commercial 2 research purposes only
no-ai 3 may not be used to train
no-ai 3 opt out of (?:ai|machine learning) training
no-ai 3 text and data mining rights reserved
copyright 2 copyright notice
copyright 2 all content copyright
copyright 2 subject to copyright
copyright 2 protected by copyright
copyright 2 courtesy of the copyright holder
terms 1 terms of (?:use|service)
terms 2 terms and conditions apply
terms 2 subject to our terms
terms 2 using this (?:site|website|service) you agree
"""
RULES = _rules()


def _width(pattern: str) -> int:
    """Words that a rule can take at most: one more than blanks, those of a repeated group as often as it may repeat."""
    spread = re.sub(r"\((\?:[^()]*)\)\{\d+,(\d+)\}", lambda m: m[1] * int(m[2]), pattern)
    return spread.count(" ") + 1


#: Words that the rules of a keyword, and any rule, look at from the keyword on; the base phrases are rules, too.
REACH = {k: max(_width(r) for key, r, _, _ in RULES if key == k) for k in {r[0] for r in RULES}}
LONGEST = max(REACH.values())


def _detections() -> str:
    """The expression that tries, at each keyword, the rules of that keyword; as text, which is quicker to build."""

    def tried(i: int, regex: str, label: str, priority: int) -> str:
        size = f"size(split(regexp_extract(x.words, '{regex}', 0), ' '))"
        return f"if(rlike(x.words, '{regex}'), named_struct('at', x.at, 'size', {size}, 'label', '{label}', 'priority', {priority}, 'order', {-i}), null)"

    own = {k: ", ".join(tried(i, r, label, p) for i, (key, r, label, p) in enumerate(RULES) if key == k) for k in REACH}
    branches = " ".join(f"when '{k}' then array({tries})" for k, tries in own.items())
    return f"transform(near, x -> filter(case x.key {branches} else array() end, d -> d is not null))"


_DETECTIONS = _detections()


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs.

    n_base: all places where the words of a base phrase stand one behind another; first_word and last_word: the smallest and
    largest of their starts (words from 0), else null. base_labels: labels of those phrases; labels: these and the ones
    that the rules detect, distinct, sorted, comma-joined. score: 0 without a detection, at most a half if something
    restricts the text, else at least a half; nearer to 0 or 1 with each further label. Null and empty texts have
    no words, no labels and the score 0. Texts are scanned whole, however long. Of detections at the same words the one of
    the higher priority stays, of equal ones the earlier rule. Rows that repeat an id stay rows of their own; other
    columns, whatever their names, don't count. An empty table gives an empty result.
    """
    keywords = sorted({r[0] for r in RULES} | {p.split()[0] for p in BASE})
    docs = docs.select(F.col(doc_id).alias("doc_id"), split_words(F.col(text)).alias("w"))
    marked = F.transform("w", lambda w, i: F.when(w.isin(keywords), i))
    docs = docs.withColumn("places", F.filter(marked, lambda i: i.isNotNull()))
    widths = F.create_map(*(F.lit(x) for k in keywords for x in (k, max(REACH.get(k, 0), 4) + 1)))
    docs = docs.withColumn("near", F.transform("places", lambda i: F.struct(i.alias("at"), F.col("w")[i].alias("key"), F.array_join(F.slice("w", i + 1, F.element_at(widths, F.col("w")[i])), " ").alias("words"))))
    docs = docs.select("doc_id", F.size("w").cast("long").alias("n_words"), "near")

    begins = {p: F.lit(p) for p in BASE}
    base_of = lambda x: F.coalesce(*(F.when((x["words"] == t) | x["words"].startswith(f"{p} "), F.lit(BASE[p])) for p, t in begins.items()))
    base = F.filter(F.transform("near", lambda x: F.struct(x["at"].alias("at"), base_of(x).alias("label"))), lambda x: x["label"].isNotNull())
    docs = docs.withColumns({"base": base, "all": F.expr(_DETECTIONS)})

    def stronger(b: Column, a: Column) -> Column:
        rank = lambda d: F.struct(d["priority"], d["size"], d["order"], -d["at"])
        return (b["at"] <= a["at"]) & (b["at"] + b["size"] >= a["at"] + a["size"]) & (rank(b) > rank(a))

    def left(found: Column, i: Column) -> Column:
        """The detections of a place without those inside a stronger one; LONGEST places before hold all that can be."""
        first = F.greatest(i - LONGEST, F.lit(0))
        return F.filter(found, lambda a: ~F.exists(F.flatten(F.slice("all", first + 1, i - first + 1)), lambda b: stronger(b, a)))

    docs = docs.withColumn("kept", F.flatten(F.transform("all", left)))
    starts = F.transform("base", lambda x: x["at"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.transform("kept", lambda x: x["label"]))))
    docs = docs.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), base_labels.alias("b"), labels.alias("l"))
    strict = F.exists("l", lambda label: ~F.rlike(label, F.lit(OPEN)))
    share = F.lit(0.5) / F.size("l")
    score = F.when(F.size("l") == 0, F.lit(0.0)).when(strict, share).otherwise(F.lit(1.0) - share)
    return docs.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join("l", ",").alias("labels"), score.alias("score"))
