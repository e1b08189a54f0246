"""Signatures of licences, written from the licences' own wordings and from how files name them.

A line under a label is ``kind keyword : pattern``.  Patterns speak of a text's
words in lower case, joined by one space, with punctuation gone.  The keyword
stands in everything that the pattern can match; a text without it is not
searched for the rule.  Rules count in the order in which they stand here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Kinds: what a licence's own text says, an SPDX identifier, a grant, a full name, a loose mention. (priority, confidence)
KINDS = {"text": (100, 1.0), "spdx": (90, 1.0), "grant": (80, 0.95), "name": (60, 0.8), "hint": (40, 0.5)}

SIGNATURES = r"""
mit
 text permission is hereby granted free of charge : permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
 text permission is hereby granted free of charge : permission is hereby granted free of charge to any person obtaining a copy
 text without restriction including without limitation : to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
 text shall be included in all copies or substantial : the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
 spdx spdx license identifier mit : spdx license identifier mit(?! 0| cmu| feh)
 grant under the mit license : (?:released |licensed |distributed |available |provided )?under the mit license
 grant under an mit : under an mit(?: style)? licen[cs]e
 grant under mit : (?:licensed|released|distributed) under mit(?: licen[cs]e)?
 name mit license : (?:the )?mit license(?! 0)
 name mit licence : (?:the )?mit licence
 name expat license : (?:the )?expat license
 name mit x11 : mit x11(?: licen[cs]e)?
 hint license mit : license mit
mit-0
 spdx spdx license identifier mit 0 : spdx license identifier mit 0
 name mit no attribution : mit no attribution(?: license)?
 name mit license 0 : mit license 0
apache-1.1
 text the apache group for use in the apache : this product includes software developed by the apache group for use in the apache http server project
 text the apache software foundation http www apache org : this product includes software developed by the apache software foundation http www apache org
 spdx spdx license identifier apache 1 1 : spdx license identifier apache 1 1
 grant apache software license version 1 1 : under the (?:terms of the )?apache software license version 1 1
 name apache license version 1 1 : apache license version 1 1
 name apache software license 1 1 : apache software license 1 1
apache-2
 text licensed under the apache license version 2 0 : licensed under the apache license version 2 0 the license you may not use this file except in compliance
 text apache license version 2 0 january 2004 : apache license version 2 0 january 2004
 text grant of patent license subject to the terms : grant of patent license subject to the terms and conditions of this license each contributor hereby grants
 text as is basis without warranties or conditions : distributed on an as is basis without warranties or conditions of any kind either express or implied
 text www apache org licenses license 2 0 : www apache org licenses license 2 0
 spdx spdx license identifier apache 2 0 : spdx license identifier apache 2 0
 grant the apache license : (?:released |licensed |distributed |available |provided )?under the (?:terms of the )?apache license(?: version| v)? ?2(?: 0)?
 grant under the apache 2 : (?:released |licensed |distributed |available )?under the apache 2(?: 0)?(?: licen[cs]e)?
 grant under apache : (?:licensed|released|distributed) under apache(?: license)?(?: version)? 2(?: 0)?
 name apache license version 2 : apache license version 2
 name apache license 2 0 : apache license 2 0
 name apache license v2 : apache license v2(?: 0)?
 name apache software license 2 0 : apache software license 2 0
 name asl 2 0 : asl 2 0
 hint apache 2 0 : apache 2 0
bsd-2-clause
 text this list of conditions and the following disclaimer : redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
 spdx spdx license identifier bsd 2 clause : spdx license identifier bsd 2 clause
 grant simplified bsd : under the simplified bsd licen[cs]e
 grant bsd 2 clause : under the bsd 2 clause(?: licen[cs]e)?
 name 2 clause bsd : (?:the )?2 clause bsd(?: license)?
 name bsd 2 clause : bsd 2 clause(?: simplified)?(?: license)?
 name simplified bsd license : simplified bsd license
 name freebsd license : freebsd license
 name two clause bsd : two clause bsd(?: license)?
bsd-3-clause
 text used to endorse or promote products : neither the name of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
 text used to endorse or promote products : the names? of .{1,60}? may not be used to endorse or promote products|may be used to endorse or promote products derived from this software without specific prior written permission
 spdx spdx license identifier bsd 3 clause : spdx license identifier bsd 3 clause
 grant bsd 3 clause : under the bsd 3 clause(?: licen[cs]e)?
 grant 3 clause bsd : under the (?:terms of the )?3 clause bsd(?: licen[cs]e)?
 grant new bsd license : under the new bsd license
 name 3 clause bsd : (?:the )?3 clause bsd(?: license)?
 name bsd 3 clause : bsd 3 clause(?: new| revised)?(?: license)?
 name new bsd license : new bsd license
 name modified bsd license : modified bsd license
 name revised bsd license : revised bsd license
 name three clause bsd : three clause bsd(?: license)?
bsd-4-clause
 text all advertising materials mentioning features : all advertising materials mentioning features or use of this software must display the following acknowledge?ment
 spdx spdx license identifier bsd 4 clause : spdx license identifier bsd 4 clause
 name 4 clause bsd : 4 clause bsd(?: license)?
 name original bsd license : original bsd license
bsd
 text redistribution and use in source and binary forms : redistribution and use in source and binary forms with or without modification are permitted
 grant bsd style license : under a bsd style license
 grant under the bsd license : under the bsd license
 name bsd license : (?:the )?bsd license
 name bsd licence : (?:the )?bsd licence
 name bsd style : bsd style licen[cs]e
 hint license bsd : license bsd
0bsd
 text permission to use copy modify and or distribute : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
 spdx spdx license identifier 0bsd : spdx license identifier 0bsd
 name zero clause bsd : (?:bsd )?zero clause bsd(?: license)?
isc
 text permission to use copy modify and or distribute : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
 text permission to use copy modify and distribute : permission to use copy modify and distribute this software for any purpose with or without fee
 spdx spdx license identifier isc : spdx license identifier isc
 grant the isc license : (?:licensed )?under the (?:terms of the )?isc license
 name isc license : (?:the )?isc license
 name isc licence : (?:the )?isc licence
gpl-1
 spdx spdx license identifier gpl 1 0 : spdx license identifier gpl 1 0
 name gnu general public license version 1 : gnu general public license version 1
gpl-2
 text either version 2 of the license : general public license as published by the free software foundation either version 2 of the license or at your option any later version
 text gnu general public license version 2 june 1991 : gnu general public license version 2 june 1991
 text version 2 as published by the free software : under the terms of the gnu general public license version 2 as published by the free software foundation
 text the gnu general public license does not permit : the gnu general public license does not permit incorporating your program into proprietary programs
 spdx spdx license identifier gpl 2 0 : spdx license identifier gpl 2 0(?: only| or later)?
 grant gnu general public license version 2 : under (?:the )?(?:terms of )?(?:the )?gnu general public license version 2
 grant under the gpl : under the gpl ?v?(?:ersion )?2(?: 0)?
 grant under gplv2 : under gplv2
 name gnu general public license version 2 : gnu general public license version 2
 name gnu general public license v2 : gnu general public license v2(?: 0)?
 name gnu gpl v2 : gnu gpl v2
 name gpl version 2 : gpl version 2
 name gplv2 : gplv2
 name gpl 2 0 : gpl 2 0
 hint gpl 2 : gpl 2
gpl-3
 text either version 3 of the license : gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
 text gnu general public license version 3 29 june 2007 : gnu general public license version 3 29 june 2007
 text is a free copyleft license for software : the gnu general public license is a free copyleft license for software and other kinds of works
 spdx spdx license identifier gpl 3 0 : spdx license identifier gpl 3 0(?: only| or later)?
 grant gnu general public license version 3 : under (?:the )?(?:terms of )?(?:the )?gnu general public license version 3
 grant under the gpl : under the gpl ?v?(?:ersion )?3(?: 0)?
 grant under gplv3 : under gplv3
 name gnu general public license version 3 : gnu general public license version 3
 name gnu general public license v3 : gnu general public license v3(?: 0)?
 name gnu gpl v3 : gnu gpl v3
 name gpl version 3 : gpl version 3
 name gplv3 : gplv3
 name gpl 3 0 : gpl 3 0
 hint gpl 3 : gpl 3
gpl
 text you should have received a copy of the gnu general : you should have received a copy of the gnu general public license along with this program
 grant the gnu general public license : under the (?:terms of the )?gnu general public license
 grant terms of the gnu general public license : (?:redistribute it and or modify it )?under the terms of the gnu general public license
 grant under the gpl : under the gpl(?: licen[cs]e)?
 name gnu general public licen : gnu general public licen[cs]e
 name gnu gpl : gnu gpl
 hint gpl license : gpl licensed?
 hint gpl licence : gpl licence
lgpl-2
 text library general public license : gnu library general public license version 2 june 1991
 spdx spdx license identifier lgpl 2 0 : spdx license identifier lgpl 2 0(?: only| or later)?
 name library general public license : (?:gnu )?library general public license
lgpl-2.1
 text gnu lesser general public license version 2 1 : gnu lesser general public license version 2 1 february 1999
 text either version 2 1 of the license : lesser general public license as published by the free software foundation either version 2 1 of the license
 spdx spdx license identifier lgpl 2 1 : spdx license identifier lgpl 2 1(?: only| or later)?
 name lesser general public license version 2 1 : (?:gnu )?lesser general public license version 2 1
 name lesser general public license v2 1 : (?:gnu )?lesser general public license v2 1
 name lgpl 2 1 : lgpl 2 1
 name lgplv2 1 : lgplv2 1
lgpl-3
 text gnu lesser general public license version 3 : gnu lesser general public license version 3 29 june 2007
 text either version 3 of the license : lesser general public license as published by the free software foundation either version 3 of the license
 spdx spdx license identifier lgpl 3 0 : spdx license identifier lgpl 3 0(?: only| or later)?
 name lesser general public license version 3 : (?:gnu )?lesser general public license version 3
 name lgplv3 : lgplv3
 name lgpl 3 0 : lgpl 3 0
lgpl
 text received a copy of the gnu lesser general public : you should have received a copy of the gnu lesser general public license
 grant lgpl : under the (?:terms of the )?(?:gnu )?lgpl
 name lesser general public license : (?:gnu )?lesser general public license
 hint lgpl license : lgpl licensed?
agpl-3
 text gnu affero general public license version 3 : gnu affero general public license version 3 19 november 2007
 text affero general public license as published : affero general public license as published by the free software foundation either version 3
 spdx spdx license identifier agpl 3 0 : spdx license identifier agpl 3 0(?: only| or later)?
 grant agpl : under the (?:gnu )?agpl(?: ?v?3)?
 name affero general public license : (?:gnu )?affero general public license(?: version 3| v3)?
 name agplv3 : agplv3
 name agpl 3 0 : agpl 3 0
mpl-1.1
 text mozilla public license version 1 1 : the contents of this file are subject to the mozilla public license version 1 1
 spdx spdx license identifier mpl 1 1 : spdx license identifier mpl 1 1
 name mozilla public license version 1 1 : mozilla public license version 1 1
 name mpl 1 1 : mpl 1 1
mpl-2
 text subject to the terms of the mozilla public license : this source code form is subject to the terms of the mozilla public license v 2 0
 text was not distributed with this file you can obtain : if a copy of the mpl was not distributed with this file you can obtain one at
 spdx spdx license identifier mpl 2 0 : spdx license identifier mpl 2 0
 grant the mozilla public license : (?:under|subject to) (?:the )?(?:terms of )?the mozilla public license(?: version| v)? ?2(?: 0)?
 name mozilla public license version 2 0 : mozilla public license version 2 0
 name mozilla public license 2 0 : mozilla public license 2 0
 name mpl 2 0 : mpl 2 0
 name mplv2 : mplv2
mpl
 grant the mozilla public license : (?:under|subject to) (?:the )?(?:terms of )?the mozilla public license
 name mozilla public license : mozilla public license
epl-1
 text provided under the terms of this eclipse public : the accompanying program is provided under the terms of this eclipse public license
 spdx spdx license identifier epl 1 0 : spdx license identifier epl 1 0
 name eclipse public license v1 0 : eclipse public license v1 0
 name eclipse public license version 1 0 : eclipse public license version 1 0
epl-2
 text terms of the eclipse public license v 2 0 : made available under the terms of the eclipse public license v 2 0
 text terms of the eclipse public license 2 0 : made available under the terms of the eclipse public license 2 0
 spdx spdx license identifier epl 2 0 : spdx license identifier epl 2 0
 name eclipse public license version 2 0 : eclipse public license version 2 0
 name eclipse public license v2 0 : eclipse public license v2 0
epl
 name eclipse public license : eclipse public license
edl-1
 name eclipse distribution license : eclipse distribution license(?: v 1 0| version 1 0)?
cpl-1
 text provided under the terms of this common public : the accompanying program is provided under the terms of this common public license
 name common public license : common public license(?: version 1 0)?
ipl-1
 name ibm public license : ibm public license(?: version 1 0)?
cddl-1
 text subject to the terms of the common development : the contents of this file are subject to the terms of the common development and distribution license
 spdx spdx license identifier cddl 1 : spdx license identifier cddl 1 [01]
 name common development and distribution license : common development and distribution license
 name cddl 1 0 : cddl 1 0
zlib
 text altered source versions must be plainly marked : altered source versions must be plainly marked as such
 text in no event will the authors be held liable for any : this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
 text the origin of this software must not be : the origin of this software must not be misrepresented
 spdx spdx license identifier zlib : spdx license identifier zlib
 grant under the zlib : under the zlib(?: libpng)? licen[cs]e
 name zlib license : zlib license
 name zlib libpng license : zlib libpng license
libpng
 name libpng license : libpng license
unlicense
 text free and unencumbered software released into : this is free and unencumbered software released into the public domain
 text copy modify publish use compile sell or distribute : anyone is free to copy modify publish use compile sell or distribute this software
 spdx spdx license identifier unlicense : spdx license identifier unlicense
 name the unlicense : the unlicense
 name unlicense org : unlicense org
wtfpl
 text do what the fuck you want to public license : do what the fuck you want to public license
 text you just do what the fuck you want to : you just do what the fuck you want to
 spdx spdx license identifier wtfpl : spdx license identifier wtfpl
 name wtfpl : wtfpl
artistic-1
 name artistic license 1 0 : artistic license 1 0
artistic-2
 text the artistic license 2 0 copyright : the artistic license 2 0 copyright c 2000 2006 the perl foundation
 spdx spdx license identifier artistic 2 0 : spdx license identifier artistic 2 0
 name artistic license 2 0 : artistic license 2 0
 name artistic license version 2 0 : artistic license version 2 0
artistic
 grant under the artistic license : under the artistic license
 name artistic license : artistic license
perl
 grant same terms as perl : (?:under the )?same terms as perl(?: itself)?
boost-1
 text boost software license version 1 0 : boost software license version 1 0 august 17th 2003
 grant under the boost software license : (?:distributed )?under the boost software license(?: version 1 0)?
 spdx spdx license identifier bsl 1 0 : spdx license identifier bsl 1 0
 name boost software license : boost software license
postgresql
 text documentation for any purpose without fee : permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
 spdx spdx license identifier postgresql : spdx license identifier postgresql
 name postgresql licen : postgresql licen[cs]e
python-2
 text python software foundation license version 2 : python software foundation license version 2
 text psf hereby grants licensee a nonexclusive : psf hereby grants licensee a nonexclusive royalty free world wide license
 spdx spdx license identifier psf 2 0 : spdx license identifier psf 2 0
 name python software foundation license : python software foundation license
 name psf license : psf license
ruby
 grant same terms as ruby : (?:under the )?same terms as ruby(?: itself)?
 name ruby license : ruby license
php-3
 text the php license version 3 0 : the php license version 3 01?
 name php license : php license
openssl
 text openssl project for use in the openssl toolkit : developed by the openssl project for use in the openssl toolkit
 name openssl license : openssl license
curl
 spdx spdx license identifier curl : spdx license identifier curl
 name curl license : curl license
icu
 name icu license : icu license
unicode
 text unicode data files and software : unicode data files and software
 name unicode license agreement : unicode license agreement
ofl-1.1
 text sil open font license version 1 1 : sil open font license version 1 1 26 february 2007
 text font software is licensed under the sil open font : this font software is licensed under the sil open font license
 spdx spdx license identifier ofl 1 1 : spdx license identifier ofl 1 1
 name open font license : (?:sil )?open font license(?: version 1 1)?
 name ofl 1 1 : ofl 1 1
gfdl
 text terms of the gnu free documentation license : under the terms of the gnu free documentation license
 spdx spdx license identifier gfdl : spdx license identifier gfdl 1 [123]
 name gnu free documentation license : gnu free documentation license
 name gfdl : gfdl
cc0-1
 text cc0 1 0 universal : cc0 1 0 universal
 text creativecommons org publicdomain zero 1 0 : creativecommons org publicdomain zero 1 0
 text has waived all copyright and related : has waived all copyright and related or neighboring rights
 spdx spdx license identifier cc0 1 0 : spdx license identifier cc0 1 0
 name cc0 : cc0(?: 1 0)?(?: license)?
 name cc zero : cc zero
cc-by
 text creativecommons org licenses by : creativecommons org licenses by [1-4] [05]
 spdx spdx license identifier cc by : spdx license identifier cc by [1-4] [05]
 grant creative commons attribution : under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e
 name creative commons attribution : creative commons attribution(?: [1-4] [05])?(?: international)?
 hint cc by : cc by(?! sa| nd| nc)(?: [1-4] [05])?
cc-by-sa
 text creativecommons org licenses by sa : creativecommons org licenses by sa [1-4] [05]
 spdx spdx license identifier cc by sa : spdx license identifier cc by sa [1-4] [05]
 grant creative commons attribution share : under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? licen[cs]e
 name creative commons attribution share : creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?
 hint cc by sa : cc by sa(?: [1-4] [05])?
cc-by-nd
 text creativecommons org licenses by nd : creativecommons org licenses by nd [1-4] [05]
 spdx spdx license identifier cc by nd : spdx license identifier cc by nd [1-4] [05]
 name creative commons attribution no : creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
 hint cc by nd : cc by nd(?: [1-4] [05])?
cc-by-nc
 text creativecommons org licenses by nc : creativecommons org licenses by nc [1-4] [05]
 spdx spdx license identifier cc by nc : spdx license identifier cc by nc [1-4] [05]
 grant creative commons attribution non : under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)? licen[cs]e
 name creative commons attribution non : creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?
 hint cc by nc : cc by nc(?: [1-4] [05])?
cc-by-nc-sa
 text creativecommons org licenses by nc sa : creativecommons org licenses by nc sa [1-4] [05]
 spdx spdx license identifier cc by nc sa : spdx license identifier cc by nc sa [1-4] [05]
 name creative commons attribution non : creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?
 hint cc by nc sa : cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd
 text creativecommons org licenses by nc nd : creativecommons org licenses by nc nd [1-4] [05]
 spdx spdx license identifier cc by nc nd : spdx license identifier cc by nc nd [1-4] [05]
 name creative commons attribution non : creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international)?
 hint cc by nc nd : cc by nc nd(?: [1-4] [05])?
odbl-1
 text open data commons open database license : open data commons open database license
 name open database license : open database license
 name odbl : odbl(?: 1 0)?
pddl-1
 name public domain dedication and license : public domain dedication and license
odc-by-1
 name open data commons attribution license : open data commons attribution license
eupl-1.2
 text licensed under the e : licensed under the (?:eupl|european union public licen[cs]e)(?: v| version)? ?1 2
 spdx spdx license identifier eupl 1 : spdx license identifier eupl 1 [12]
 name european union public licen : european union public licen[cs]e
cecill-2
 text governed by the cecill : this software is governed by the cecill(?: c| b)? license under french law
 name cecill license : cecill license
ms-pl
 text microsoft public license ms pl : microsoft public license ms pl
 name microsoft public license : microsoft public license
ms-rl
 name microsoft reciprocal license : microsoft reciprocal license
osl-3
 text licensed under the open software license version 3 : licensed under the open software license version 3 0
 name open software license : open software license
afl-3
 name academic free license : academic free license(?: version| v)?(?: 3 0)?
upl-1
 text universal permissive license : universal permissive license(?: version| v)? ?1 0
 spdx spdx license identifier upl 1 0 : spdx license identifier upl 1 0
ncsa
 text university of illinois ncsa open source license : university of illinois ncsa open source license
 name ncsa open source license : ncsa open source license
w3c
 text w3c software notice and license : w3c software notice and license
 name w3c license : w3c license
 name w3c software and document : w3c software and document (?:notice and )?license
vim
 name vim license : vim license
tcl
 name tcl tk license : tcl tk license
x11
 text the x consortium : except as contained in this notice the name of the x consortium shall not be used
 name x11 license : x11 license
hpnd
 name historical permission notice and disclaimer : historical permission notice and disclaimer
json
 text used for good not evil : the software shall be used for good not evil
 name json license : json license
beerware
 text the beer ware license : the beer ware license
 text you can buy me a beer in return : you think this stuff is worth it you can buy me a beer in return
qpl-1
 name q public license : q public license(?: version 1 0)?
watcom-1
 name sybase open watcom public license : sybase open watcom public license
apsl-2
 name apple public source license : apple public source license(?: version 2 0)?
sspl-1
 text server side public license version 1 : server side public license version 1 october 16 2018
 name server side public license : server side public license
busl-1.1
 text business source license 1 1 : business source license 1 1
 text means the date on which the licensed work : the change date means the date on which the licensed work
 name business source license : business source license
elastic-2
 name elastic license : elastic license(?: 2 0| v2)?
commons-clause
 text commons clause license condition : commons clause license condition
 name commons clause : commons clause
polyform
 name polyform noncommercial license : polyform noncommercial license
 name polyform small business license : polyform small business license
openrail
 text responsible ai license : responsible ai license
 name creativeml open rail : creativeml open rail ?m?
 name openrail : openrail(?: m)?
llama-community
 name llama 2 community license : llama 2 community license
 name llama 3 community license : llama 3 community license
public-domain
 text released into the public domain : (?:is |was |been )?released into the public domain
 grant in the public domain : (?:is |placed |dedicated )in the public domain
 grant to the public domain : dedicated to the public domain
 hint public domain : public domain
proprietary
 text unauthorized copying of this file : unauthorized copying of this file via any medium is strictly prohibited
 text proprietary and confidential : proprietary and confidential
 text is the confidential and proprietary information : this software is the confidential and proprietary information of
 grant may not be reproduced : may not be reproduced (?:or distributed )?(?:in any form )?without (?:the )?(?:prior )?(?:written )?permission
 hint all rights reserved : all rights reserved
"""


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keyword: str
    priority: int
    confidence: float


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """The signatures in order; a pattern matches whole words only."""
    made, label = [], ""
    for line in SIGNATURES.strip("\n").split("\n"):
        if not line.startswith(" "):
            label = line
            continue
        kind, rest = line.strip().split(" ", 1)
        keyword, pattern = rest.split(" : ", 1)
        made.append(Rule(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), keyword, *KINDS[kind]))
    return tuple(made)
