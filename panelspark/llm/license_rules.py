"""Signature rules for licences, one a line: label | kind | keyword | regular expression.

The expressions run on lower-case bytes; a space in one stands for white space and comment marks between words, so notices may
wrap anywhere. ~{a,b} stands for a gap: of a to b characters (a run of white space and marks is one), or of any length where no
licence is named in it. A rule's keyword must occur in a text, runs of white space and marks taken as one space, before its
expression is tried. Kinds, from the surest: tag, notice, title, url, name, hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: What a kind weighs in the choice between detections, and how sure it is.
KINDS = {"tag": (60, 0.99), "notice": (50, 0.97), "title": (40, 0.93), "url": (40, 0.9), "name": (30, 0.8), "hint": (10, 0.5)}

TABLE = r"""
gpl-3.0 | notice | general public license | gnu general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 3\b
gpl-3.0 | title | general public license | gnu general public license \(?(?:version |v\.? ?)?3(?:\.0)?\b
gpl-3.0 | url | gnu.org | gnu\.org/licenses/gpl-3
gpl-3.0 | name | gpl | \bgpl[ -]?(?:v|version )?\.? ?3(?:\.0)?\b
gpl-3.0-or-later | notice | general public license | general public license~{0,80}version 3(?:\.0)?,? (?:of the license,? )?or \(?at your option\)? any later
gpl-3.0-or-later | tag | gpl | \bgpl-3\.0(?:-or-later|\+)
gpl-3.0-only | tag | gpl | \bgpl-3\.0-only\b
gpl-2.0 | notice | general public license | gnu general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 2\b
gpl-2.0 | title | general public license | gnu general public license \(?(?:version |v\.? ?)?2(?:\.0)?\b
gpl-2.0 | url | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2
gpl-2.0 | name | gpl | \bgpl[ -]?(?:v|version )?\.? ?2(?:\.0)?\b
gpl-2.0-or-later | notice | general public license | general public license~{0,80}version 2(?:\.0)?,? (?:of the license,? )?or \(?at your option\)? any later
gpl-2.0-or-later | tag | gpl | \bgpl-2\.0(?:-or-later|\+)
gpl-2.0-only | tag | gpl | \bgpl-2\.0-only\b
gpl-2.0-classpath | notice | classpath | general public license~{0,120}classpath exception
gpl-1.0 | title | general public license | gnu general public license,? \(?(?:version |v\.? ?)1(?:\.0)?\b
gpl | hint | gpl | \b(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl\b
gpl | url | gnu.org | gnu\.org/licenses/gpl\b
lgpl-3.0 | notice | lesser general public | lesser general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 3\b
lgpl-3.0 | title | lesser general public | lesser general public license \(?(?:version |v\.? ?)?3(?:\.0)?\b
lgpl-3.0 | name | lgpl | \blgpl[ -]?(?:v|version )?\.? ?3(?:\.0)?\b
lgpl-3.0 | url | gnu.org | gnu\.org/licenses/lgpl-3
lgpl-2.1 | notice | lesser general public | lesser general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 2\.1\b
lgpl-2.1 | title | lesser general public | lesser general public license \(?(?:version |v\.? ?)?2\.1\b
lgpl-2.1 | name | lgpl | \blgpl[ -]?(?:v|version )?\.? ?2\.1\b
lgpl-2.1 | url | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-2.0 | notice | library general public | gnu library general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 2\b
lgpl-2.0 | name | lgpl | \blgpl[ -]?(?:v|version )?\.? ?2(?:\.0)?\b(?!\.1)
lgpl | name | lesser general public | \bgnu lesser general public license\b
lgpl | hint | lgpl | \blgpl\b
agpl-3.0 | notice | affero | affero general public license,? (?:as published by the free software foundation,? )?(?:either )?\(?version 3\b
agpl-3.0 | title | affero | affero general public license \(?(?:version |v\.? ?)?3(?:\.0)?\b
agpl-3.0 | name | agpl | \bagpl[ -]?(?:v|version )?\.? ?3(?:\.0)?\b
agpl-3.0 | url | gnu.org | gnu\.org/licenses/agpl
agpl-1.0 | title | affero | affero general public license,? \(?(?:version |v\.? ?)1(?:\.0)?\b
agpl | hint | affero | \baffero general public license\b
gfdl-1.3 | title | free documentation | gnu free documentation license,? \(?(?:version |v\.? ?)?1\.3\b
gfdl-1.2 | title | free documentation | gnu free documentation license,? \(?(?:version |v\.? ?)?1\.2\b
gfdl-1.1 | title | free documentation | gnu free documentation license,? \(?(?:version |v\.? ?)?1\.1\b
gfdl | name | free documentation | \bgnu free documentation license\b
gfdl | url | gnu.org | gnu\.org/(?:copyleft|licenses)/fdl
apache-2.0 | notice | apache license | licensed under the apache license,? version 2(?:\.0)?
apache-2.0 | notice | apache license | (?:released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache license,? (?:version |v\.? ?)?2(?:\.0)?
apache-2.0 | title | apache license | apache license,? \(?(?:version |v\.? ?)?2(?:\.0)?\b
apache-2.0 | title | apache software license | apache software license,? \(?(?:version |v\.? ?)?2(?:\.0)?\b
apache-2.0 | name | apache | \bapache[ -](?:license[ -])?(?:v|version )?\.? ?2(?:\.0)?\b
apache-2.0 | name | asl | \basl ?2\.0\b
apache-2.0 | url | apache.org | apache\.org/licenses/license-2
apache-1.1 | title | apache | apache (?:software )?license,? \(?(?:version |v\.? ?)?1\.1\b
apache-1.1 | url | apache.org | apache\.org/licenses/license-1\.1
apache-1.0 | title | apache | apache (?:software )?license,? \(?(?:version |v\.? ?)?1\.0\b
apache | hint | apache | \bunder (?:the )?apache licen[sc]e\b
mit | notice | mit licen | (?:licensed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | notice | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit | title | the mit license | \bthe mit license \(mit\)
mit | name | mit licen | \bmit licen[sc]e\b
mit | name | expat | \bexpat licen[sc]e\b
mit | url | opensource.org | opensource\.org/licenses/mit\b
mit | url | mit-license.org | mit-license\.org
mit-0 | name | mit | \bmit no attribution\b
mit-0 | tag | mit-0 | \bmit-0\b
mit-cmu | notice | permission to use, copy | permission to use, copy,? modify,? and distribute this software and its documentation for any purpose and without fee
x11 | name | x11 | \bx11 licen[sc]e\b
isc | notice | permission to use, copy | permission to use, copy,? modify,? and/?(?:or)? distribute this software for any purpose with or without fee
isc | name | isc licen | \bisc licen[sc]e\b
isc | url | opensource.org | opensource\.org/licenses/isc\b
0bsd | name | bsd | \b(?:0bsd|zero[ -]clause bsd|bsd zero[ -]clause)\b
bsd-2-clause | name | bsd | \b(?:bsd[ -]2[ -]clause|(?:2|two)[ -]clause bsd|simplified bsd|freebsd licen[sc]e)\b
bsd-2-clause | url | opensource.org | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | name | bsd | \b(?:bsd[ -]3[ -]clause|(?:3|three)[ -]clause bsd|(?:new|revised|modified) bsd)\b
bsd-3-clause | notice | neither the name | neither the names? of ~{1,120} may be used to endorse or promote products
bsd-3-clause | url | opensource.org | opensource\.org/licenses/bsd-3-clause
bsd-3-clause-clear | name | bsd | \bclear bsd licen[sc]e\b
bsd-4-clause | name | bsd | \b(?:bsd[ -]4[ -]clause|(?:4|four)[ -]clause bsd|original bsd|old bsd)\b
bsd-4-clause | notice | advertising materials | all advertising materials mentioning features or use of this software
bsd | notice | redistribution and use | redistribution and use in source and binary forms,? with or without modification
bsd | hint | bsd | \bbsd(?:[ -]style)? licen[sc]e\b
bsd | url | opensource.org | opensource\.org/licenses/bsd-license
mpl-2.0 | notice | mozilla public | subject to the terms of the mozilla public license,? v(?:\.|ersion)? ?2\.0
mpl-2.0 | title | mozilla public | mozilla public license,? \(?(?:version |v\.? ?)?2(?:\.0)?\b
mpl-2.0 | name | mpl | \bmpl[ -]?(?:v|version )?\.? ?2(?:\.0)?\b
mpl-2.0 | url | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | title | mozilla public | mozilla public license,? \(?(?:version |v\.? ?)?1\.1\b
mpl-1.1 | name | mpl | \bmpl[ -]?(?:v|version )?\.? ?1\.1\b
mpl-1.1 | url | mozilla.org | mozilla\.org/(?:en-us/)?mpl/1\.1
mpl-1.0 | title | mozilla public | mozilla public license,? \(?(?:version |v\.? ?)?1\.0\b
mpl | hint | mozilla public | \bmozilla public license\b
epl-2.0 | title | eclipse public | eclipse public license,? (?:- )?\(?(?:version |v\.? ?)?2(?:\.0)?\b
epl-2.0 | url | eclipse.org | eclipse\.org/legal/epl-(?:2\.0|v20)
epl-2.0 | name | epl | \bepl[ -]?(?:v|version )?\.? ?2(?:\.0)?\b
epl-1.0 | title | eclipse public | eclipse public license,? (?:- )?\(?(?:version |v\.? ?)?1(?:\.0)?\b
epl-1.0 | url | eclipse.org | eclipse\.org/legal/epl-v10
epl-1.0 | name | epl | \bepl[ -]?(?:v|version )?\.? ?1(?:\.0)?\b
epl | hint | eclipse public | \beclipse public license\b
edl-1.0 | name | eclipse distribution | \beclipse distribution license\b
cddl-1.1 | title | common development and distribution | common development and distribution license,? \(?(?:cddl\)?,? )?(?:version |v\.? ?)?1\.1\b
cddl-1.0 | title | common development and distribution | common development and distribution license,? \(?(?:cddl\)?,? )?(?:version |v\.? ?)?1\.0\b
cddl-1.0 | name | cddl | \bcddl[ -]?(?:v|version )?\.? ?1\.0\b
cddl-1.1 | name | cddl | \bcddl[ -]?(?:v|version )?\.? ?1\.1\b
cddl | hint | cddl | \bcddl\b
cpl-1.0 | name | common public license | \bcommon public license(?:,? (?:version |v\.? ?)?1\.0)?\b
ipl-1.0 | name | ibm public license | \bibm public license\b
cc0-1.0 | name | cc0 | \bcc0(?:[ -]1\.0)?\b
cc0-1.0 | title | creative commons zero | \bcreative commons zero\b
cc0-1.0 | url | creativecommons.org | creativecommons\.org/publicdomain/zero
cc-pdm | url | creativecommons.org | creativecommons\.org/publicdomain/mark
cc-by-4.0 | title | creative commons attribution | creative commons attribution,? (?:international )?(?:public license )?4\.0
cc-by-4.0 | title | creative commons attribution | creative commons attribution 4\.0
cc-by-4.0 | name | cc | \bcc[ -]by[ -](?:v(?:ersion)? ?)?4(?:\.0)?\b
cc-by-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by/4
cc-by-3.0 | name | cc | \bcc[ -]by[ -](?:v(?:ersion)? ?)?3(?:\.0)?\b
cc-by-3.0 | title | creative commons attribution | creative commons attribution 3\.0
cc-by-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by/3
cc-by-2.5 | name | cc | \bcc[ -]by[ -]2\.5\b
cc-by-2.5 | url | creativecommons.org | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | name | cc | \bcc[ -]by[ -]2(?:\.0)?\b(?!\.5)
cc-by-2.0 | url | creativecommons.org | creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 | name | cc | \bcc[ -]by[ -]sa[ -]4(?:\.0)?\b
cc-by-sa-4.0 | title | creative commons attribution | creative commons attribution[ -]share[ -]?alike 4\.0
cc-by-sa-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by-sa/4
cc-by-sa-3.0 | name | cc | \bcc[ -]by[ -]sa[ -]3(?:\.0)?\b
cc-by-sa-3.0 | title | creative commons attribution | creative commons attribution[ -]share[ -]?alike 3\.0
cc-by-sa-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by-sa/3
cc-by-sa-2.0 | url | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5 | url | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.5
cc-by-nc-4.0 | name | cc | \bcc[ -]by[ -]nc[ -]4(?:\.0)?\b
cc-by-nc-4.0 | title | creative commons attribution | creative commons attribution[ -]non[ -]?commercial 4\.0
cc-by-nc-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc/4
cc-by-nc-3.0 | name | cc | \bcc[ -]by[ -]nc[ -]3(?:\.0)?\b
cc-by-nc-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc/3
cc-by-nc-sa-4.0 | name | cc | \bcc[ -]by[ -]nc[ -]sa[ -]4(?:\.0)?\b
cc-by-nc-sa-4.0 | title | creative commons attribution | creative commons attribution[ -]non[ -]?commercial[ -]share[ -]?alike 4\.0
cc-by-nc-sa-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4
cc-by-nc-sa-3.0 | name | cc | \bcc[ -]by[ -]nc[ -]sa[ -]3(?:\.0)?\b
cc-by-nc-sa-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3
cc-by-nc-nd-4.0 | name | cc | \bcc[ -]by[ -]nc[ -]nd[ -]4(?:\.0)?\b
cc-by-nc-nd-4.0 | title | creative commons attribution | creative commons attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:ative)?s 4\.0
cc-by-nc-nd-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4
cc-by-nc-nd-3.0 | name | cc | \bcc[ -]by[ -]nc[ -]nd[ -]3(?:\.0)?\b
cc-by-nc-nd-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3
cc-by-nd-4.0 | name | cc | \bcc[ -]by[ -]nd[ -]4(?:\.0)?\b
cc-by-nd-4.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nd/4
cc-by-nd-3.0 | url | creativecommons.org | creativecommons\.org/licenses/by-nd/3
cc-by-nc-nd | name | cc | \bcc[ -]by[ -]nc[ -]nd\b(?![ -]\d)
cc-by-nc-sa | name | cc | \bcc[ -]by[ -]nc[ -]sa\b(?![ -]\d)
cc-by-nc | name | cc | \bcc[ -]by[ -]nc\b(?![ -](?:\d|sa|nd))
cc-by-sa | name | cc | \bcc[ -]by[ -]sa\b(?![ -]\d)
cc-by-nd | name | cc | \bcc[ -]by[ -]nd\b(?![ -]\d)
cc-by | name | cc | \bcc[ -]by\b(?![ -](?:\d|sa|nd|nc))
cc | hint | creative commons | \bcreative commons (?:attribution )?licen[sc]e\b
odbl-1.0 | name | open database | \bopen database licen[sc]e\b
odbl-1.0 | url | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by-1.0 | name | open data commons | \bopen data commons attribution\b
odc-by-1.0 | url | opendatacommons.org | opendatacommons\.org/licenses/by
pddl-1.0 | name | public domain dedication | \b(?:odc )?public domain dedication and licen[sc]e\b
pddl-1.0 | url | opendatacommons.org | opendatacommons\.org/licenses/pddl
ogl-uk-3.0 | name | open government | \bopen government licen[sc]e v?(?:ersion )?3(?:\.0)?\b
ogl-uk-2.0 | name | open government | \bopen government licen[sc]e v?(?:ersion )?2(?:\.0)?\b
ogl | hint | open government | \bopen government licen[sc]e\b
cdla-permissive-2.0 | name | community data license | community data license agreement.{0,5}permissive,? (?:version )?2\.0
cdla-permissive-1.0 | name | community data license | community data license agreement.{0,5}permissive,? (?:version )?1\.0
cdla-sharing-1.0 | name | community data license | community data license agreement.{0,5}sharing
unlicense | notice | public domain | this is free and unencumbered software released into the public domain
unlicense | name | unlicense | \bthe unlicense\b
unlicense | url | unlicense.org | unlicense\.org
wtfpl | name | wtfpl | \bwtfpl\b
wtfpl | title | what the fuck you want | do what the fuck you want to public license
public-domain | notice | public domain | \b(?:dedicated|released|placed|donated) (?:in)?to the public domain\b
public-domain | hint | public domain | \bin the public domain\b
zlib | notice | altered source versions | altered source versions must be plainly marked as such
zlib | name | zlib | \bzlib(?:/libpng)? licen[sc]e\b
libpng-2.0 | name | libpng | \blibpng licen[sc]e\b
bsl-1.0 | name | boost software | \bboost software license\b
bsl-1.0 | url | boost.org | boost\.org/license_1_0
busl-1.1 | name | business source | \bbusiness source license(?: 1\.1)?\b
artistic-2.0 | name | artistic license | \bartistic license,? \(?(?:version |v\.? ?)?2(?:\.0)?\b
artistic-1.0 | name | artistic license | \bartistic license,? \(?(?:version |v\.? ?)?1(?:\.0)?\b
artistic | hint | artistic license | \bartistic license\b
perl | notice | same terms as perl | under the same terms as perl
psf-2.0 | name | python software foundation | \bpython software foundation license\b
python-2.0 | name | python license | \bpython license 2\.0\b
ruby | name | ruby license | \bruby license\b
php-3.01 | name | php license | \bphp license,? (?:version |v\.? ?)?3\.01\b
php-3.0 | name | php license | \bphp license,? (?:version |v\.? ?)?3\.0\b
openssl | name | openssl license | \bopenssl license\b
postgresql | name | postgresql license | \bpostgresql license\b
vim | name | vim license | \bvim license\b
curl | name | curl license | \bcurl license\b
ncsa | name | ncsa | \b(?:university of illinois/)?ncsa open source license\b
upl-1.0 | name | universal permissive | \buniversal permissive license\b
ecl-2.0 | name | educational community | \beducational community license\b
afl-3.0 | name | academic free | \bacademic free license,? (?:version |v\.? ?)?3\.0\b
afl-2.1 | name | academic free | \bacademic free license,? (?:version |v\.? ?)?2\.1\b
osl-3.0 | name | open software license | \bopen software license,? (?:version |v\.? ?)?3\.0\b
osl-2.1 | name | open software license | \bopen software license,? (?:version |v\.? ?)?2\.1\b
eupl-1.2 | name | european union public | \beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.2\b
eupl-1.1 | name | european union public | \beuropean union public licen[sc]e,? (?:version |v\.? ?)?1\.1\b
eupl-1.2 | name | eupl | \beupl[ -]?(?:v|version )?\.? ?1\.2\b
cecill-2.1 | name | cecill | \bcecill[ -]?(?:v|version )?\.? ?2\.1\b
cecill-b | name | cecill | \bcecill-b\b
cecill-c | name | cecill | \bcecill-c\b
cecill | hint | cecill | \bcecill\b
ms-pl | name | microsoft public | \bmicrosoft public license\b
ms-rl | name | microsoft reciprocal | \bmicrosoft reciprocal license\b
ofl-1.1 | name | open font license | \b(?:sil )?open font license,? (?:version )?1\.1\b
ofl | hint | open font license | \bopen font license\b
ofl-1.1 | url | scripts.sil.org | scripts\.sil\.org/ofl
sspl-1.0 | name | server side public | \bserver side public license\b
elastic-2.0 | name | elastic license | \belastic license(?: 2\.0)?\b
bigscience-rail | name | openrail | \b(?:bigscience |creativeml )?openrail(?:-m|\+\+-m)?\b
llama-community | name | llama | \bllama (?:\d(?:\.\d)? )?community license\b
json | notice | good, not evil | shall be used for good, not evil
beerware | name | beer | \bbeer-?ware licen[sc]e\b
unicode-dfs | name | unicode license | \bunicode license agreement\b
blueoak-1.0.0 | name | blue oak | \bblue oak model license\b
mulan-psl-2.0 | name | mulan | \bmulan permissive software license\b
parity-7.0 | name | parity public | \bparity public license\b
polyform-noncommercial | name | polyform | \bpolyform noncommercial\b
commons-clause | name | commons clause | \bcommons clause\b
all-rights-reserved | hint | all rights reserved | \ball rights reserved\b
proprietary | hint | proprietary | \bproprietary and confidential\b
"""


#: Bytes between words, and the expressions for a run of them and for one character of a gap; possessive, so that long runs aren't split in many ways.
MARKS = rb"\s*#/;"
BETWEEN = b"(?:[" + MARKS + b"]++)"
ANY = b"(?:" + BETWEEN + b"|[^" + MARKS + b"])"


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: re.Pattern


def compiled(pattern: str) -> re.Pattern:
    text = re.sub(r"\[ -\]", "(?:\x00|-)", pattern).replace(" ", "\x00").encode().replace(b"\x00", BETWEEN)
    text = re.sub(rb"~\{(\d+),(\d+)\}", lambda m: b"(?:%b{%b,%b}|(?:(?!licen)%b){%b,}?)" % (ANY, *m.groups(), ANY, m[1]), text)
    return re.compile(re.sub(rb"(?<!\\)\.\{", lambda m: ANY + b"{", text))


def rules() -> list[Rule]:
    """All rules in their order; of two detections of one priority the earlier rule's stands."""
    out = []
    for line in TABLE.strip().splitlines():
        label, kind, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        priority, confidence = KINDS[kind]
        out.append(Rule(label, priority, confidence, keyword.encode(), compiled(pattern)))
    return out
