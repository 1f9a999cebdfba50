"""Hand-written license signatures, in order.

One rule per line: label; level; keyword; pattern. Patterns run over the words of a text in lower
case, joined by single spaces, and match whole words only. A rule is tried only in texts that hold
its keyword, which every match of its pattern does. Levels rank detections: 0 a license tag or notice, 1 a full title, 2 a short name,
3 a mention that points to a license without naming it.
"""

from __future__ import annotations

from typing import NamedTuple

SIGNATURES = r"""
mit;0;license;under the mit license
apache-2;0;apache;apache license version 2
cc-by-nc;0;cc;cc by nc
spdx:mit;0;spdx;spdx license identifier mit
spdx:apache-2;0;spdx;spdx license identifier apache 2 0
spdx:bsd-2;0;spdx;spdx license identifier bsd 2 clause
spdx:bsd-3;0;spdx;spdx license identifier bsd 3 clause
spdx:gpl-2;0;spdx;spdx license identifier gpl 2 0(?: only)?
spdx:gpl-2+;0;spdx;spdx license identifier gpl 2 0 or later
spdx:gpl-3;0;spdx;spdx license identifier gpl 3 0(?: only)?
spdx:gpl-3+;0;spdx;spdx license identifier gpl 3 0 or later
spdx:lgpl-2.1;0;spdx;spdx license identifier lgpl 2 1(?: only)?
spdx:lgpl-2.1+;0;spdx;spdx license identifier lgpl 2 1 or later
spdx:lgpl-3;0;spdx;spdx license identifier lgpl 3 0(?: only)?
spdx:agpl-3;0;spdx;spdx license identifier agpl 3 0(?: only)?
spdx:agpl-3+;0;spdx;spdx license identifier agpl 3 0 or later
spdx:mpl-2;0;spdx;spdx license identifier mpl 2 0
spdx:isc;0;spdx;spdx license identifier isc
spdx:epl-2;0;spdx;spdx license identifier epl 2 0
spdx:unlicense;0;spdx;spdx license identifier unlicense
spdx:cc0;0;spdx;spdx license identifier cc0 1 0
spdx:cc-by-4;0;spdx;spdx license identifier cc by 4 0
spdx:cc-by-sa-4;0;spdx;spdx license identifier cc by sa 4 0
spdx:zlib;0;spdx;spdx license identifier zlib
spdx:bsl-1;0;spdx;spdx license identifier bsl 1 0
spdx:other;3;spdx;spdx license identifier [^ ]+
mit;0;permission;permission is hereby granted free of charge to any person obtaining a copy
mit;1;mit;(?:the )?mit x11 licen[cs]e
mit;1;mit;(?:the )?mit licen[cs]e(?: mit)?
mit;2;mit;mit licen[cs]ed
mit;2;mit;licen[cs]ed under mit
mit;1;expat;(?:the )?expat licen[cs]e
mit-0;1;mit;mit no attribution(?: licen[cs]e)?
mit-0;2;mit;mit 0 licen[cs]e
x11;1;x11;(?:the )?x11 licen[cs]e
x11;2;consortium;x consortium licen[cs]e
isc;0;permission;permission to use copy modify and or distribute this software for any purpose
isc;1;isc;(?:the )?isc licen[cs]e
isc;2;isc;licen[cs]ed under (?:the )?isc
apache-2;0;apache;licen[cs]ed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?
apache-2;1;apache;apache software licen[cs]e version 2(?: 0)?
apache-2;1;apache;apache licen[cs]e 2(?: 0)?
apache-2;1;apache;apache licen[cs]e v2(?: 0)?
apache-2;2;apache;apache 2(?: 0)? licen[cs]e
apache-2;2;apache;apache v2(?: 0)?
apache-2;2;asl;asl 2 0
apache-2;0;apache;apache org licenses licen[cs]e 2 0
apache-1.1;1;apache;apache (?:software )?licen[cs]e (?:version )?1 1
apache-1;1;apache;apache (?:software )?licen[cs]e (?:version )?1 0
apache;3;apache;apache (?:software )?licen[cs]e
bsd-0;1;bsd;(?:zero clause|0 clause) bsd(?: licen[cs]e)?
bsd-0;1;bsd;bsd zero clause licen[cs]e
bsd-1;1;bsd;bsd 1 clause licen[cs]e
bsd-2;1;bsd;bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2;1;bsd;(?:2|two) clause bsd(?: licen[cs]e)?
bsd-2;2;bsd;simplified bsd licen[cs]e
bsd-2;2;freebsd;freebsd licen[cs]e
bsd-3;1;bsd;bsd 3 clause(?: new| revised)?(?: licen[cs]e)?
bsd-3;1;bsd;(?:3|three) clause bsd(?: licen[cs]e)?
bsd-3;2;bsd;(?:new|modified|revised) bsd licen[cs]e
bsd-3-clear;1;bsd;bsd 3 clause clear licen[cs]e
bsd-4;1;bsd;bsd 4 clause(?: original)?(?: licen[cs]e)?
bsd-4;1;bsd;(?:4|four) clause bsd(?: licen[cs]e)?
bsd-4;2;bsd;(?:original|old) bsd licen[cs]e
bsd;0;redistribution;redistribution and use in source and binary forms with or without modification are permitted
bsd;2;bsd;(?:a |the )?bsd style licen[cs]e
bsd;3;bsd;bsd licen[cs]e
bsd;3;bsd;bsd licen[cs]ed
gpl-1;1;general public;gnu general public licen[cs]e version 1(?: 0)?
gpl-2;0;general public;gnu general public licen[cs]e version 2(?: 0)?(?: only)?
gpl-2+;0;general public;gnu general public licen[cs]e version 2 or (?:any )?later(?: version)?
gpl-2+;0;general public;gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3;0;general public;gnu general public licen[cs]e version 3(?: 0)?(?: only)?
gpl-3+;0;general public;gnu general public licen[cs]e version 3 or (?:any )?later(?: version)?
gpl-3+;0;general public;gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-3;1;general public;gnu general public licen[cs]e v ?3(?: 0)?
gpl-2;1;general public;gnu general public licen[cs]e v ?2(?: 0)?
gpl;2;general public;gnu general public licen[cs]e
gpl;3;general public;general public licen[cs]e
gpl-2;2;gpl;(?:gnu )?gpl (?:version )?(?:v )?2(?: 0)?(?: only)?
gpl-2;2;gplv2;(?:gnu )?gplv2(?: only)?
gpl-2+;2;gplv2;(?:gnu )?gplv2 or later
gpl-2+;2;gpl;(?:gnu )?gpl 2(?: 0)? or later
gpl-3;2;gpl;(?:gnu )?gpl (?:version )?(?:v )?3(?: 0)?(?: only)?
gpl-3;2;gplv3;(?:gnu )?gplv3(?: only)?
gpl-3+;2;gplv3;(?:gnu )?gplv3 or later
gpl-3+;2;gpl;(?:gnu )?gpl 3(?: 0)? or later
gpl;3;gpl;gnu gpl
gpl;3;gpl;(?:the|under) gpl
gpl;3;gpl;gpl licen[cs]ed?
gpl-classpath;1;classpath;(?:gpl|gnu general public licen[cs]e) (?:version 2 )?with (?:the )?classpath exception
gpl-linking;2;linking exception;gpl with (?:a )?linking exception
lgpl-2;1;library general;gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2.1;0;lesser general;gnu lesser general public licen[cs]e version 2 1(?: only)?
lgpl-2.1+;0;lesser general;gnu lesser general public licen[cs]e version 2 1 or (?:any )?later(?: version)?
lgpl-2.1+;0;lesser general;gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-3;0;lesser general;gnu lesser general public licen[cs]e version 3(?: 0)?(?: only)?
lgpl-3+;0;lesser general;gnu lesser general public licen[cs]e version 3 or (?:any )?later(?: version)?
lgpl;2;lesser general;(?:gnu )?lesser general public licen[cs]e
lgpl-2.1;2;lgpl;(?:gnu )?lgpl (?:version |v )?2 1(?: only)?
lgpl-2.1;2;lgplv2;lgplv2(?: 1)?
lgpl-3;2;lgpl;(?:gnu )?lgpl (?:version |v )?3(?: 0)?(?: only)?
lgpl-3;2;lgplv3;lgplv3
lgpl;3;lgpl;(?:gnu )?lgpl
agpl-1;1;affero;affero general public licen[cs]e version 1(?: 0)?
agpl-3;0;affero;gnu affero general public licen[cs]e version 3(?: 0)?(?: only)?
agpl-3+;0;affero;gnu affero general public licen[cs]e version 3 or (?:any )?later(?: version)?
agpl;2;affero;(?:gnu )?affero general public licen[cs]e
agpl;3;affero;affero gpl
agpl-3;2;agpl;(?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3;2;agplv3;agplv3
agpl;3;agpl;(?:gnu )?agpl
gfdl-1.2;1;free documentation;gnu free documentation licen[cs]e version 1 2
gfdl-1.3;1;free documentation;gnu free documentation licen[cs]e version 1 3
gfdl;2;free documentation;gnu free documentation licen[cs]e
gfdl;3;gfdl;gfdl
mpl-1;1;mozilla;mozilla public licen[cs]e (?:version |v )?1 0
mpl-1.1;1;mozilla;mozilla public licen[cs]e (?:version |v )?1 1
mpl-2;0;mozilla;this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0
mpl-2;1;mozilla;mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl;2;mozilla;mozilla public licen[cs]e
mpl-2;2;mpl;mpl (?:version |v )?2(?: 0)?
mpl-1.1;2;mpl;mpl (?:version |v )?1 1
epl-1;1;eclipse;eclipse public licen[cs]e (?:version |v )?1 0
epl-2;1;eclipse;eclipse public licen[cs]e (?:version |v )?2 0
epl;2;eclipse;eclipse public licen[cs]e
edl;1;eclipse;eclipse distribution licen[cs]e(?: v 1 0)?
epl-1;2;epl;epl (?:v )?1 0
epl-2;2;epl;epl (?:v )?2 0
cpl-1;1;common public;common public licen[cs]e(?: version 1 0)?
cddl-1;1;common development;common development and distribution licen[cs]e (?:version )?1 0
cddl-1.1;1;common development;common development and distribution licen[cs]e (?:version )?1 1
cddl;2;common development;common development and distribution licen[cs]e
cddl;3;cddl;cddl(?: 1 [01])?
eupl-1.1;1;european union;european union public licen[cs]e (?:version |v )?1 1
eupl-1.2;1;european union;european union public licen[cs]e (?:version |v )?1 2
eupl;2;european union;european union public licen[cs]e
eupl;3;eupl;eupl(?: v? ?1 [12])?
cecill-2;1;cecill;cecill (?:free software licen[cs]e )?(?:version |v )?2(?: [01])?
cecill;2;cecill;cecill(?: [bc])?
ms-pl;1;microsoft;microsoft public licen[cs]e
ms-rl;1;microsoft;microsoft reciprocal licen[cs]e
ms-pl;2;ms pl;ms pl licen[cs]e
artistic-1;1;artistic;artistic licen[cs]e (?:version )?1 0
artistic-2;1;artistic;artistic licen[cs]e (?:version )?2 0
artistic;2;artistic;(?:the )?artistic licen[cs]e
perl;2;perl;same terms as perl(?: itself)?
zlib;0;altered;altered source versions must be plainly marked as such
zlib;1;zlib;(?:the )?zlib(?: libpng)? licen[cs]e
libpng;1;libpng;(?:the )?libpng licen[cs]e
boost-1;0;boost;distributed under the boost software licen[cs]e version 1 0
boost-1;1;boost;boost software licen[cs]e(?: version 1 0)?
python;1;python;python software foundation licen[cs]e(?: version 2)?
python;2;psf;psf licen[cs]e
ruby;1;ruby;(?:the )?ruby licen[cs]e
php;1;php;php licen[cs]e (?:version )?3 01
php;2;php;php licen[cs]e
postgresql;1;postgresql;postgresql licen[cs]e
openssl;1;openssl;openssl licen[cs]e
ntp;1;ntp;ntp licen[cs]e
curl;1;curl;curl licen[cs]e
vim;1;vim;vim licen[cs]e
tcl;1;tcl;tcl tk licen[cs]e
icu;1;icu;icu licen[cs]e
unicode;1;unicode;unicode (?:inc )?licen[cs]e agreement(?: data files and software)?
w3c;1;w3c;w3c software (?:notice and )?licen[cs]e
wtfpl;1;do what;do what the fuck you want to public licen[cs]e
wtfpl;2;wtfpl;wtfpl
beerware;1;beer;beer ?ware licen[cs]e
beerware;1;beer;the beer ware licen[cs]e
unlicense;0;encumbered;this is free and unencumbered software released into the public domain
unlicense;1;unlicense;(?:the )?unlicense
ofl-1.1;0;open font;sil open font licen[cs]e version 1 1
ofl;1;open font;(?:sil )?open font licen[cs]e
ofl;2;ofl;sil ofl
afl-3;1;academic free;academic free licen[cs]e (?:version |v )?3 0
afl;2;academic free;academic free licen[cs]e
osl-3;1;open software;open software licen[cs]e (?:version |v )?3 0
osl;2;open software;open software licen[cs]e
qpl;1;q public;q public licen[cs]e
sspl-1;1;server side;server side public licen[cs]e(?: version 1)?
sspl-1;2;sspl;sspl(?: 1 0)?
busl-1.1;1;business source;business source licen[cs]e(?: 1 1)?
elastic-2;1;elastic;elastic licen[cs]e(?: 2 0)?
commons-clause;1;commons clause;commons clause(?: licen[cs]e condition)?
polyform-nc;1;polyform;polyform noncommercial licen[cs]e(?: 1 0 0)?
odbl-1;1;open database;open database licen[cs]e(?: v ?1 0)?
odbl-1;2;odbl;odbl
odc-by;1;open data commons;open data commons attribution licen[cs]e(?: v ?1 0)?
pddl;1;open data commons;open data commons public domain dedication and licen[cs]e
ogl-uk;1;open government;open government licen[cs]e(?: v ?[123] 0)?
cdla-permissive;1;community data;community data licen[cs]e agreement permissive
cdla-sharing;1;community data;community data licen[cs]e agreement sharing
rail;1;responsible ai;responsible ai licen[cs]e
openrail;1;openrail;(?:creativeml |bigscience )?openrail(?: ?[+]?[+]?m)?(?: licen[cs]e)?
cc0;0;cc0;cc0 1 0(?: universal)?
cc0;1;cc0;cc0
cc0;1;creative commons;creative commons zero(?: v?1 0)?
cc-by-nc-sa;0;cc;cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd;0;cc;cc by nc nd(?: [1-4] [05])?
cc-by-nc-4;0;cc;cc by nc 4 0
cc-by-nc-3;0;cc;cc by nc 3 0
cc-by-nc-2;0;cc;cc by nc 2 [05]
cc-by-sa-4;0;cc;cc by sa 4 0
cc-by-sa-3;0;cc;cc by sa 3 0
cc-by-sa-2;0;cc;cc by sa 2 [05]
cc-by-sa;1;cc;cc by sa
cc-by-nd-4;0;cc;cc by nd 4 0
cc-by-nd;1;cc;cc by nd(?: [1-3] [05])?
cc-by-4;0;cc;cc by 4 0
cc-by-3;0;cc;cc by 3 0
cc-by-2;0;cc;cc by 2 [05]
cc-by;2;cc;cc by
cc-by-nc-sa;1;creative commons;creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd;1;creative commons;creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc;1;creative commons;creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa;1;creative commons;creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd;1;creative commons;creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by;1;creative commons;creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc;2;creative commons;creative commons licen[cs]e
cc;3;creative commons;creative commons
public-domain;0;public domain;(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain;1;public domain;this work is in the public domain
public-domain;2;public domain;public domain dedication
public-domain;3;public domain;public domain
proprietary;0;reserved;(?:proprietary and )?confidential all rights reserved
proprietary;1;reserved;all rights reserved
proprietary;1;proprietary;proprietary licen[cs]e
proprietary;2;commercial;commercial licen[cs]e
proprietary;1;reproduced;no part of this (?:publication|book|work|document) may be reproduced
proprietary;2;permission;may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission
eula;1;end user;end user licen[cs]e agreement
eula;2;eula;eula
copyright;2;copyright;copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright;3;copyright;copyright notice
copyleft;3;copyleft;copyleft
royalty-free;2;royalty;royalty free licen[cs]e
open-source;3;open source;open source licen[cs]e
free-software;3;free software;free software licen[cs]e
noncommercial;2;commercial;for non ?commercial (?:use|purposes) only
research-only;2;research;for (?:academic and )?research (?:use|purposes) only
licensed;3;licen;licen[cs]ed under (?:the )?(?:terms of )?(?:the )?[^ ]+(?: [^ ]+)? licen[cs]e
see-license;3;licen;see (?:the )?(?:accompanying )?licen[cs]e(?: txt| md| file)?
"""


class Rule(NamedTuple):
    no: int
    label: str
    level: int
    keyword: str
    pattern: str


def read_rules(text: str) -> list[Rule]:
    lines = [line for line in text.strip().splitlines() if line.strip()]
    parts = [line.split(";", 3) for line in lines]
    return [Rule(no, a, int(b), k, p) for no, (a, b, k, p) in enumerate(parts)]


RULES = read_rules(SIGNATURES)
BASE_RULES = 3  # the first ones: phrases that are always counted
