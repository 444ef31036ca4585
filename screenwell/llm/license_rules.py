"""Signature rules of the license scan, written by hand.

A line is: priority, label, keyword, regex.  Regexes run on the text's words (lower case, one blank between, so
`2.0` is `2 0`), match whole words, and always contain their keyword.  A lower priority wins: 1 identifier tags and
sentences of a license's own text, 2 names with a version, 3 names, 4 web addresses, 5 families, 6 general notices.
"""

from __future__ import annotations

import re
from typing import NamedTuple

RULES = r"""
1 mit             spdx        spdx license identifier mit
1 apache-2.0      spdx        spdx license identifier apache 2 0
1 bsd-2           spdx        spdx license identifier bsd 2 clause(?: patent)?
1 bsd-3           spdx        spdx license identifier bsd 3 clause(?: clear)?
1 bsd-0           spdx        spdx license identifier 0bsd
1 isc             spdx        spdx license identifier isc
1 gpl-2.0         spdx        spdx license identifier gpl 2 0(?: only| or later)?
1 gpl-3.0         spdx        spdx license identifier gpl 3 0(?: only| or later)?
1 lgpl-2.1        spdx        spdx license identifier lgpl 2 1(?: only| or later)?
1 lgpl-3.0        spdx        spdx license identifier lgpl 3 0(?: only| or later)?
1 agpl-3.0        spdx        spdx license identifier agpl 3 0(?: only| or later)?
1 mpl-2.0         spdx        spdx license identifier mpl 2 0(?: no copyleft exception)?
1 epl-2.0         spdx        spdx license identifier epl 2 0
1 epl-1.0         spdx        spdx license identifier epl 1 0
1 cddl            spdx        spdx license identifier cddl 1 [01]
1 unlicense       spdx        spdx license identifier unlicense
1 cc0             spdx        spdx license identifier cc0 1 0
1 cc-by           spdx        spdx license identifier cc by [1-4] [05]
1 cc-by-sa        spdx        spdx license identifier cc by sa [1-4] [05]
1 cc-by-nc        spdx        spdx license identifier cc by nc [1-4] [05]
1 cc-by-nd        spdx        spdx license identifier cc by nd [1-4] [05]
1 cc-by-nc-sa     spdx        spdx license identifier cc by nc sa [1-4] [05]
1 cc-by-nc-nd     spdx        spdx license identifier cc by nc nd [1-4] [05]
1 zlib            spdx        spdx license identifier zlib
1 bsl-1.0         spdx        spdx license identifier bsl 1 0
1 wtfpl           spdx        spdx license identifier wtfpl
1 artistic-2.0    spdx        spdx license identifier artistic 2 0
1 ofl-1.1         spdx        spdx license identifier ofl 1 1
1 python-2.0      spdx        spdx license identifier (?:python|psf) 2 0
1 postgresql      spdx        spdx license identifier postgresql
1 mit             furnished   permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: \S+){0,40}? furnished to do so
1 mit             copies      the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit             noninfringement the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
1 bsd             redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 bsd             binary      redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
1 bsd-3           endorse     neither the name of(?: \S+){1,12}? nor the names of its contributors may be used to endorse or promote products derived from this software
1 bsd-4           advertising all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
1 isc             fee         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 apache-2.0      licensed    licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache-2.0      unless      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
1 gpl             redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1 gpl             useful      distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
1 gpl             received    you should have received a copy of the gnu general public license along with this program
1 lgpl            redistribute this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
1 lgpl            received    you should have received a copy of the gnu (?:lesser|library) general public license along with this library
1 agpl            received    you should have received a copy of the gnu affero general public license along with this program
1 mpl-2.0         form        this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl-1.1         contents    the contents of this file are subject to the mozilla public license version 1 1
1 epl             accompanying this program and the accompanying materials are made available under the terms of the eclipse public license
1 unlicense       unencumbered this is free and unencumbered software released into the public domain
1 unlicense       compile     anyone is free to copy modify publish use compile sell or distribute this software
1 zlib            altered     altered source versions must be plainly marked as such and must not be misrepresented as being the original software
1 zlib            held        in no event will the authors be held liable for any damages arising from the use of this software
1 bsl-1.0         boost       boost software license version 1 0 august 17th 2003
1 wtfpl           fuck        do what the fuck you want to public license
1 wtfpl           fuck        you just do what the fuck you want to
1 beerware        beer        buy me a beer in return
1 cc0             waived      (?:has|have) waived all copyright and related or neighboring rights to
1 postgresql      paragraph   provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
1 ofl-1.1         font        this font software is licensed under the sil open font license version 1 1
1 curl            advertising except as contained in this notice the name of a copyright holder shall not be used in advertising
1 openssl         openssl     this product includes software developed by the openssl project
1 php             php         this product includes php software freely available from
1 json            evil        the software shall be used for good not evil
2 apache-2.0      apache      (?:the )?apache (?:software )?license (?:version |v |v)?2(?: 0)?
2 apache-2.0      apache      apache 2(?: 0)? licen[cs]ed?
2 apache-2.0      asl         asl (?:version )?2 0
2 apache-1.1      apache      (?:the )?apache software license (?:version )?1 1
2 apache-1.0      apache      (?:the )?apache (?:software )?license (?:version )?1 0
2 gpl-1.0         general     gnu general public license (?:version |v )?1(?: 0)?
2 gpl-2.0         general     gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )2(?: 0)?
2 gpl-3.0         general     gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )3(?: 0)?
2 gpl-2.0         gpl         gpl (?:version |v )?2(?: 0)?
2 gpl-3.0         gpl         gpl (?:version |v )?3(?: 0)?
2 gpl-2.0         gplv2       (?:gnu )?gplv2
2 gpl-3.0         gplv3       (?:gnu )?gplv3
2 lgpl-2.0        library     gnu library general public license (?:version |v )?2(?: 0)?
2 lgpl-2.1        lesser      gnu lesser general public license (?:version |v )?2 1
2 lgpl-3.0        lesser      gnu lesser general public license (?:version |v )?3(?: 0)?
2 lgpl-2.1        lgpl        lgpl (?:version |v )?2 1
2 lgpl-3.0        lgpl        lgpl (?:version |v )?3(?: 0)?
2 lgpl-2.1        lgplv2      lgplv2(?: 1)?
2 lgpl-3.0        lgplv3      lgplv3
2 agpl-1.0        affero      affero general public license (?:version |v )?1(?: 0)?
2 agpl-3.0        affero      (?:gnu )?affero general public license (?:version |v )?3(?: 0)?
2 agpl-3.0        agpl        (?:gnu )?agpl (?:version |v )?3(?: 0)?
2 agpl-3.0        agplv3      agplv3
2 gfdl-1.1        documentation gnu free documentation license (?:version )?1 1
2 gfdl-1.2        documentation gnu free documentation license (?:version )?1 2
2 gfdl-1.3        documentation gnu free documentation license (?:version )?1 3
2 mpl-1.0         mozilla     mozilla public license (?:version |v )?1 0
2 mpl-1.1         mozilla     mozilla public license (?:version |v )?1 1
2 mpl-2.0         mozilla     mozilla public license (?:version |v )?2(?: 0)?
2 mpl-1.1         mpl         mpl (?:version |v )?1 1
2 mpl-2.0         mpl         mpl (?:version |v )?2(?: 0)?
2 epl-1.0         eclipse     eclipse public license (?:version |v )?1(?: 0)?
2 epl-2.0         eclipse     eclipse public license (?:version |v )?2(?: 0)?
2 edl-1.0         eclipse     eclipse distribution license (?:version |v )?1(?: 0)?
2 cddl-1.0        development common development and distribution license (?:version |v )?1 0
2 cddl-1.1        development common development and distribution license (?:version |v )?1 1
2 cpl-1.0         common      common public license (?:version |v )?1 0
2 ipl-1.0         ibm         ibm public license (?:version |v )?1 0
2 eupl-1.1        union       european union public licen[cs]e (?:version |v )?1 1
2 eupl-1.2        union       european union public licen[cs]e (?:version |v )?1 2
2 eupl-1.2        eupl        eupl (?:version |v )?1 2
2 osl-2.1         open        open software license (?:version |v )?2 1
2 osl-3.0         open        open software license (?:version |v )?3 0
2 afl-2.1         academic    academic free license (?:version |v )?2 1
2 afl-3.0         academic    academic free license (?:version |v )?3 0
2 artistic-1.0    artistic    artistic license (?:version |v )?1 0
2 artistic-2.0    artistic    artistic license (?:version |v )?2 0
2 bsl-1.0         boost       boost software license (?:version |v )?1 0
2 bsl-1.1         business    business source license (?:version |v )?1 1
2 ecl-2.0         educational educational community license (?:version |v )?2 0
2 lppl-1.3        latex       latex project public license (?:version |v )?1 3[abc]?
2 ofl-1.0         sil         sil open font license (?:version |v )?1 0
2 ofl-1.1         sil         sil open font license (?:version |v )?1 1
2 php-3.0         php         php license (?:version |v )?3 0
2 php-3.01        php         php license (?:version |v )?3 01
2 python-2.0      python      python software foundation license (?:version |v )?2
2 zpl-2.1         zope        zope public license (?:version |v )?2 1
2 zpl-2.0         zope        zope public license (?:version |v )?2 0
2 qpl-1.0         q           q public license (?:version |v )?1 0
2 npl-1.1         netscape    netscape public license (?:version |v )?1 1
2 apsl-2.0        apple       apple public source license (?:version |v )?2 0
2 sspl-1.0        side        server side public license (?:version |v )?1
2 elastic-2.0     elastic     elastic license (?:version |v )?2 0
2 ms-pl           microsoft   microsoft public license
2 ms-rl           microsoft   microsoft reciprocal license
2 mulan-2.0       mulan       mulan (?:permissive software license|psl) (?:version |v |v)?2
2 cecill-2.0      cecill      cecill (?:version |v )?2 0
2 cecill-2.1      cecill      cecill (?:version |v )?2 1
2 odbl-1.0        database    open (?:data commons open )?database license(?: odbl)? (?:version |v )?1 0
2 pddl-1.0        dedication  public domain dedication and license (?:version |v )?1 0
2 cc-by-1.0       attribution creative commons attribution 1 0(?: \S+)? licen[cs]e
2 cc-by-2.0       attribution creative commons attribution 2 0(?: \S+)? licen[cs]e
2 cc-by-2.5       attribution creative commons attribution 2 5(?: \S+)? licen[cs]e
2 cc-by-3.0       attribution creative commons attribution 3 0(?: \S+)? licen[cs]e
2 cc-by-4.0       attribution creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
2 cc-by-sa-3.0    alike       creative commons attribution share alike 3 0
2 cc-by-sa-3.0    sharealike  creative commons attribution sharealike 3 0
2 cc-by-sa-4.0    sharealike  creative commons attribution sharealike 4 0(?: international)?
2 cc-by-nc-3.0    noncommercial creative commons attribution noncommercial 3 0
2 cc-by-nc-4.0    noncommercial creative commons attribution noncommercial 4 0(?: international)?
2 cc-by-nd-3.0    noderivs    creative commons attribution noderivs 3 0
2 cc-by-nd-4.0    noderivatives creative commons attribution noderivatives 4 0(?: international)?
2 cc-by-nc-sa-4.0 noncommercial creative commons attribution noncommercial sharealike 4 0(?: international)?
2 cc-by-nc-nd-4.0 noncommercial creative commons attribution noncommercial noderivatives 4 0(?: international)?
2 cc-by-1.0       cc          cc by 1 0
2 cc-by-2.0       cc          cc by 2 0
2 cc-by-2.5       cc          cc by 2 5
2 cc-by-3.0       cc          cc by 3 0
2 cc-by-4.0       cc          cc by 4 0
2 cc-by-sa-2.0    sa          cc by sa 2 0
2 cc-by-sa-2.5    sa          cc by sa 2 5
2 cc-by-sa-3.0    sa          cc by sa 3 0
2 cc-by-sa-4.0    sa          cc by sa 4 0
2 cc-by-nc-2.0    nc          cc by nc 2 0
2 cc-by-nc-3.0    nc          cc by nc 3 0
2 cc-by-nc-4.0    nc          cc by nc 4 0
2 cc-by-nd-3.0    nd          cc by nd 3 0
2 cc-by-nd-4.0    nd          cc by nd 4 0
2 cc-by-nc-sa-3.0 nc          cc by nc sa 3 0
2 cc-by-nc-sa-4.0 nc          cc by nc sa 4 0
2 cc-by-nc-nd-3.0 nc          cc by nc nd 3 0
2 cc-by-nc-nd-4.0 nc          cc by nc nd 4 0
2 cc0             cc0         (?:creative commons )?cc0 1 0(?: universal)?
2 cc0             zero        creative commons zero(?: v1 0| 1 0)?
3 mit             mit         (?:the )?mit(?: style| x11| expat)? licen[cs]ed?
3 mit             expat       expat licen[cs]e
3 mit-0           attribution mit no attribution
3 x11             x11         x11 licen[cs]e
3 bsd-2           simplified  simplified bsd licen[cs]e
3 bsd-2           freebsd     freebsd licen[cs]e
3 bsd-2           bsd         (?:the )?bsd 2 clause(?: licen[cs]e)?
3 bsd-2           bsd         (?:2|two) clause bsd(?: licen[cs]e)?
3 bsd-3           bsd         (?:the )?bsd 3 clause(?: licen[cs]e)?
3 bsd-3           bsd         (?:3|three) clause bsd(?: licen[cs]e)?
3 bsd-3           bsd         (?:new|modified|revised) bsd licen[cs]e
3 bsd-4           bsd         (?:4|four) clause bsd(?: licen[cs]e)?
3 bsd-4           bsd         original bsd licen[cs]e
3 bsd-0           bsd         zero clause bsd(?: licen[cs]e)?
3 isc             isc         (?:the )?isc licen[cs]ed?
3 ncsa            ncsa        (?:university of illinois )?ncsa open source licen[cs]e
3 zlib            zlib        zlib(?: libpng)? licen[cs]e
3 libpng          libpng      libpng licen[cs]e
3 curl            curl        curl licen[cs]e
3 openssl         openssl     openssl licen[cs]e
3 openldap        openldap    openldap public licen[cs]e
3 postgresql      postgresql  postgresql licen[cs]e
3 vim             vim         vim licen[cs]e
3 ruby            ruby        (?:the )?ruby licen[cs]e
3 perl            perl        (?:under the )?same terms as perl itself
3 tcl             tcl         tcl tk licen[cs]e
3 w3c             w3c         w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e
3 icu             icu         (?:unicode )?icu licen[cs]e
3 unicode         unicode     unicode (?:data files and software )?licen[cs]e
3 freetype        freetype    freetype (?:project )?licen[cs]e
3 imagemagick     imagemagick imagemagick licen[cs]e
3 ijg             jpeg        independent jpeg group(?: licen[cs]e)?
3 unlicense       unlicense   (?:the )?unlicense
3 wtfpl           wtfpl       wtfpl
3 beerware        beerware    beerware(?: licen[cs]e)?
3 ofl             font        open font licen[cs]e
3 gfdl            documentation (?:gnu )?free documentation licen[cs]e
3 odbl            odbl        odbl
3 odc-by          attribution open data commons attribution licen[cs]e
3 cdla            community   community data license agreement
3 openrail        openrail    (?:creativeml )?openrail(?: m)?(?: licen[cs]e)?
3 hippocratic     hippocratic hippocratic licen[cs]e
3 commons-clause  clause      commons clause
3 polyform        polyform    polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[cs]e)?
3 fair-use        fair        fair use (?:licen[cs]e|notice)
3 jpnic           jpnic       jpnic licen[cs]e
3 sleepycat       sleepycat   sleepycat licen[cs]e
3 intel           intel       intel (?:simplified software|open source) licen[cs]e
3 oracle-upl      permissive  universal permissive licen[cs]e
3 blueoak         oak         blue oak model licen[cs]e
4 apache-2.0      apache      apache org licenses license 2 0
4 mit             opensource  opensource org licenses mit(?: license)?
4 bsd             opensource  opensource org licenses bsd (?:2|3) clause
4 gpl             gnu         gnu org licenses (?:old licenses )?gpl(?: [23] 0)?
4 lgpl            gnu         gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?
4 agpl            gnu         gnu org licenses agpl(?: 3 0)?
4 mpl             mozilla     mozilla org mpl(?: 2 0)?
4 epl             eclipse     eclipse org legal epl(?: v[12]0| 2 0)?
4 cc0             creativecommons creativecommons org publicdomain zero
4 public-domain   creativecommons creativecommons org publicdomain mark
4 cc-by           creativecommons creativecommons org licenses by [1-4] [05]
4 cc-by-sa        creativecommons creativecommons org licenses by sa [1-4] [05]
4 cc-by-nc        creativecommons creativecommons org licenses by nc [1-4] [05]
4 cc-by-nd        creativecommons creativecommons org licenses by nd [1-4] [05]
4 cc-by-nc-sa     creativecommons creativecommons org licenses by nc sa [1-4] [05]
4 cc-by-nc-nd     creativecommons creativecommons org licenses by nc nd [1-4] [05]
4 unlicense       unlicense   unlicense org
4 wtfpl           wtfpl       wtfpl net
5 cc-by-nc-sa     nc          cc by nc sa
5 cc-by-nc-nd     nc          cc by nc nd
5 cc-by-nc        nc          cc by nc
5 cc-by-nd        nd          cc by nd
5 cc-by-sa        sa          cc by sa
5 agpl            affero      (?:gnu )?affero general public licen[cs]e
5 lgpl            lesser      (?:gnu )?lesser general public licen[cs]e
5 lgpl            library     (?:gnu )?library general public licen[cs]e
5 lgpl            lgpl        (?:gnu )?lgpl
5 agpl            agpl        (?:gnu )?agpl
5 gpl             gpl         gnu gpl
5 mpl             mozilla     mozilla public licen[cs]e
5 epl             eclipse     eclipse public licen[cs]e
5 cddl            distribution common development and distribution licen[cs]e
5 apache          apache      (?:the )?apache (?:software )?licen[cs]ed?
5 bsd             bsd         bsd(?: style| like)? licen[cs]ed?
5 artistic        artistic    (?:perl )?artistic licen[cs]e
5 eupl            eupl        eupl
5 psf             python      python software foundation licen[cs]e
5 boost           boost       boost software licen[cs]e
5 creative-commons commons    creative commons(?: licen[cs]ed?)?
6 public-domain   domain      (?:is |are |been |placed |released )?(?:in|into|to) the public domain
6 public-domain   domain      public domain (?:dedication|mark|work|software)
6 proprietary     confidential proprietary and confidential
6 proprietary     confidential confidential and proprietary
6 proprietary     prohibited  unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){0,12}? (?:is )?(?:strictly )?prohibited
6 proprietary     permission  (?:may not|must not|cannot) be (?:reproduced|copied|redistributed)(?: \S+){0,10}? without(?: prior| express)?(?: written)? permission
6 eula            end         end user licen[cs]e agreement
6 commercial      commercial  commercial licen[cs]e(?: agreement)?
6 non-commercial  noncommercial (?:for )?noncommercial (?:use|purposes) only
6 non-commercial  commercial  (?:for )?non commercial (?:use|purposes)(?: only)?
6 dual            dual        dual licen[cs]ed
6 copyleft        copyleft    copyleft
6 open-source     source      (?:released|distributed|available) under an? (?:osi approved )?open source licen[cs]e
6 see-license     see         see (?:the )?(?:accompanying )?(?:license|copying|notice|licence) (?:file|txt|md)(?: for details)?
6 copyright       copyright   copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
6 copyright       copyright   (?:c )?copyright by
"""


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: bytes
    regex: re.Pattern[bytes]


def load(text: str = RULES) -> list[Rule]:
    """The rules in their order; matches are whole words, found between blanks."""
    rows = (line.split(maxsplit=3) for line in text.strip().splitlines())
    return [Rule(int(p), label, word.encode(), re.compile(rb"(?<= )(?:" + regex.encode() + rb")(?= )"))
            for p, label, word, regex in rows]
