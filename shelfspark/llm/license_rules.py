"""Hand-written license signatures, one a line: label | priority | keywords | words.

In the words a blank stands for whatever separates two words, `` ?`` for that or nothing, and the rest is a regular
expression on lower-cased text.  A rule is run only if one of its keywords (split by ``/``) is in the text; of a keyword of
several words the longest is looked for.
"""

#: Passages that only one license has, or one family.
SIGNATURES = r"""
mit | 76 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 74 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 66 | notice shall be included | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software
mit | 40 | in no event shall | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-0 | 78 | attribution | mit no attribution
mit | 64 | mit | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[sc]e
mit | 62 | mit | mit licen[sc]ed
mit | 62 | mit | licen[sc]e[sd]? mit
x11 | 68 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-2-clause | 70 | clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|bsd two clause)
bsd-2-clause | 70 | simplified bsd/freebsd | (?:simplified bsd|freebsd licen[sc]e)
bsd-3-clause | 70 | clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|bsd three clause)
bsd-3-clause | 70 | new bsd/modified bsd/revised bsd | (?:new|modified|revised) bsd(?: licen[sc]e)?
bsd-3-clause | 72 | endorse or promote | neither the name of .{1,120}? nor the names of (?:its|any|his|their) contributors may be used to endorse or promote products
bsd-4-clause | 70 | clause | (?:bsd 4 clause|4 clause bsd|four clause bsd)
bsd-4-clause | 70 | original bsd | original bsd(?: licen[sc]e)?
bsd-4-clause | 74 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-1-clause | 70 | clause | (?:bsd 1 clause|1 clause bsd)
0bsd | 76 | 0bsd/zero clause | (?:0bsd|zero clause bsd|bsd zero clause)
bsd | 58 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 56 | redistribution and use | redistribution and use in source and binary forms
bsd | 50 | redistributions of | redistributions of source code must retain the above copyright notice
bsd | 50 | redistributions in | redistributions in binary form must reproduce the above copyright notice
bsd | 48 | bsd | bsd(?: style)? licen[sc]e[ds]?
isc | 74 | permission to use | permission to use,? copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | 52 | permission to use | permission to use,? copy modify and or distribute this software
isc | 60 | isc | (?:under|of) the isc licen[sc]e
zlib | 74 | appreciated | if you use this software in a product an acknowledge?ment in the product documentation would be appreciated
zlib | 72 | altered source | altered source versions must be plainly marked as such
zlib | 70 | misrepresented | the origin of this software must not be misrepresented
zlib | 54 | provided | this software is provided as is without any express or implied warranty
libpng | 72 | libpng/png reference | (?:libpng licen[sc]e|png reference library licen[sc]e)
boost-1.0 | 78 | boost | boost software licen[sc]e version 1 0
boost-1.0 | 70 | permission is hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
apache-2.0 | 80 | apache | licensed under the apache licen[sc]e version 2 0
apache-2.0 | 78 | apache | www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 72 | unless required by | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0 | 62 | not use this file except | you may not use this file except in compliance with the licen[sc]e
apache-1.1 | 72 | apache software foundation | this product includes software developed by the apache software foundation
apache | 44 | apache software foundation | licensed to the apache software foundation under one or more contributor licen[sc]e agreements
gpl | 58 | redistribute it | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl-2.0-or-later | 92 | free software foundation | terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
gpl-3.0-or-later | 92 | free software foundation | terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl-2.0-only | 92 | free software foundation | terms of the gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation
lgpl-2.1-or-later | 93 | lesser | terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
lgpl-3.0-or-later | 93 | lesser | terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
lgpl-2.0-or-later | 93 | library | terms of the gnu library general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
agpl-3.0-or-later | 93 | affero | terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
gpl | 56 | copy of the gnu | you should have received a copy of the gnu general public licen[sc]e along with this program
lgpl | 57 | copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl | 57 | copy of the gnu | you should have received a copy of the gnu affero general public licen[sc]e
gpl-1.0 | 70 | gnu | gnu general public licen[sc]e version 1 february 1989
gpl-2.0 | 76 | gnu | gnu general public licen[sc]e version 2 june 1991
gpl-3.0 | 76 | gnu | gnu general public licen[sc]e version 3 29 june 2007
lgpl-2.0 | 76 | gnu | gnu library general public licen[sc]e version 2 june 1991
lgpl-2.1 | 76 | gnu | gnu lesser general public licen[sc]e version 2 1 february 1999
lgpl-3.0 | 76 | gnu | gnu lesser general public licen[sc]e version 3 29 june 2007
agpl-3.0 | 76 | gnu | gnu affero general public licen[sc]e version 3 19 november 2007
gpl-3.0 | 74 | gnu | www gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0 | 74 | gnu | www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
lgpl-3.0 | 74 | gnu | www gnu org licenses lgpl 3 0(?: html| txt| en html)?
lgpl-2.1 | 74 | gnu | www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
agpl-3.0 | 74 | gnu | www gnu org licenses agpl 3 0(?: html| txt| en html)?
gfdl-1.3 | 74 | gnu | www gnu org licenses fdl 1 3(?: html| txt| en html)?
gfdl | 70 | invariant sections | with no invariant sections no front cover texts and no back cover texts
gfdl | 52 | gnu | www gnu org licenses fdl(?: html| txt)?
gpl | 40 | gnu | www gnu org (?:licenses|copyleft)(?: gpl)?(?: html| txt)?
gpl | 34 | free software foundation | free software foundation(?: inc)?
gpl-2.0-with-classpath-exception | 94 | classpath | (?:gpl ?(?:v ?)?2(?: 0)? with (?:the )?)?classpath exception
gpl-2.0-with-linking-exception | 94 | linking exception | (?:gpl ?(?:v ?)?2(?: 0)? with )?(?:gcc |static |runtime )?linking exception
gpl-3.0-with-gcc-exception | 94 | runtime library exception | gcc runtime library exception
mpl-2.0 | 82 | mozilla public | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 | 82 | mozilla public | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-1.0 | 82 | mozilla public | the contents of this file are subject to the mozilla public licen[sc]e version 1 0
mpl-2.0 | 76 | mozilla | (?:www )?mozilla org mpl 2 0
mpl | 48 | mozilla | (?:www )?mozilla org mpl
npl-1.1 | 72 | netscape public | netscape public licen[sc]e(?: version)?(?: 1 1)?
epl-2.0 | 80 | eclipse public | made available under the terms of the eclipse public licen[sc]e (?:version |v )?2 0
epl-1.0 | 80 | eclipse public | made available under the terms of the eclipse public licen[sc]e (?:version |v )?1 0
epl-1.0 | 76 | eclipse | www eclipse org legal epl v10(?: html)?
epl-2.0 | 76 | eclipse | www eclipse org legal epl (?:2 0|v20)(?: html)?
cpl-1.0 | 70 | common public | common public licen[sc]e (?:version |v )?1 0
ipl-1.0 | 70 | ibm public | ibm public licen[sc]e(?: version)?(?: 1 0)?
cddl-1.0 | 76 | cddl/common development | (?:common development and distribution licen[sc]e|cddl) (?:version |v )?1 0
cpal-1.0 | 72 | common public attribution | common public attribution licen[sc]e(?: version)?(?: 1 0)?
apsl-2.0 | 72 | apple public source | apple public source licen[sc]e(?: version)?(?: 2 0)?
rpsl-1.0 | 70 | realnetworks | realnetworks public source licen[sc]e
sissl | 70 | sun industry | sun industry standards source licen[sc]e
spl-1.0 | 70 | sun public | sun public licen[sc]e
nasa-1.3 | 70 | nasa open | nasa open source agreement(?: version)?(?: 1 3)?
artistic-2.0 | 74 | artistic | artistic licen[sc]e 2 0
artistic-perl | 70 | same terms as perl | (?:under )?the same terms as perl (?:5 )?itself
python-2.0 | 74 | python software | python software foundation licen[sc]e version 2
cnri-python | 70 | cnri | cnri (?:open source )?(?:python )?licen[sc]e(?: agreement)?
ruby | 66 | ruby | ruby (?:s )?licen[sc]e
php-3.01 | 74 | php | php licen[sc]e version 3 01
vim | 66 | vim | vim licen[sc]e
tcl | 66 | tcl | tcl tk licen[sc]e
openssl | 74 | openssl | openssl (?:and ssleay )?licen[sc]e
openssl | 70 | openssl | this product includes software developed by the openssl project
ssleay | 70 | ssleay | (?:original )?ssleay licen[sc]e
curl | 66 | curl | curl licen[sc]e
ntp | 66 | ntp | ntp licen[sc]e
postgresql | 70 | postgresql | postgresql licen[sc]e
sqlite-blessing | 74 | blessing | the author disclaims copyright to this source code in place of a legal notice here is a blessing
icu | 70 | icu | icu licen[sc]e(?: icu 1 8 1 and later)?
unicode-dfs | 72 | unicode | unicode (?:inc )?licen[sc]e agreement data files and software
w3c | 70 | w3c | w3c software (?:notice and |and document )?(?:notice and )?licen[sc]e
oasis | 60 | oasis | oasis open this document and translations of it may be copied
ietf | 60 | ietf trust | ietf trust and the persons identified as the document authors
ncsa | 72 | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
upl-1.0 | 72 | universal permissive | universal permissive licen[sc]e(?: v| version)?(?: 1 0)?
ms-pl | 74 | microsoft public/ms pl | (?:microsoft public licen[sc]e|ms pl)
ms-rl | 74 | microsoft reciprocal/ms rl | (?:microsoft reciprocal licen[sc]e|ms rl)
ms-limited | 70 | microsoft limited | microsoft limited (?:public|reciprocal) licen[sc]e
eupl-1.2 | 74 | european union public/eupl | (?:european union public licen[sc]e|eupl) (?:version |v )?1 2
eupl-1.1 | 74 | european union public/eupl | (?:european union public licen[sc]e|eupl) (?:version |v )?1 1
cecill-b | 74 | cecill | cecill b(?: licen[sc]e)?
cecill-c | 74 | cecill | cecill c(?: licen[sc]e)?
mulan-psl-2.0 | 74 | mulan | mulan (?:permissive software licen[sc]e|psl)(?: version| v)? ?2
mulan-psl-1.0 | 74 | mulan | mulan (?:permissive software licen[sc]e|psl)(?: version| v)? ?1
elastic-2.0 | 76 | elastic license | elastic licen[sc]e(?: version)?(?: 2 0)?
sspl-1.0 | 76 | server side public/sspl | (?:server side public licen[sc]e|sspl)(?: version| v)?(?: 1(?: 0)?)?
busl-1.1 | 76 | business source/busl | (?:business source licen[sc]e|busl)(?: version)?(?: 1 1)?
polyform-noncommercial | 74 | polyform | polyform noncommercial licen[sc]e
polyform-small-business | 74 | polyform | polyform small business licen[sc]e
commons-clause | 74 | commons clause | commons clause licen[sc]e condition
openrail | 72 | openrail/rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m| m v1)?(?: licen[sc]e)?
llama-community | 72 | llama | llama (?:[23](?: [0-9])? )?community licen[sc]e(?: agreement)?
cdla-permissive-2.0 | 74 | community data/cdla | (?:community data licen[sc]e agreement|cdla) permissive(?: version)?(?: 2 0)?
cdla-permissive-1.0 | 76 | community data/cdla | (?:community data licen[sc]e agreement|cdla) permissive(?: version)? 1 0
cdla-sharing-1.0 | 74 | community data/cdla | (?:community data licen[sc]e agreement|cdla) sharing(?: version)?(?: 1 0)?
odbl-1.0 | 76 | open database/odbl | (?:open database licen[sc]e|odbl)(?: version| v)?(?: 1 0)?
odc-by-1.0 | 76 | open data commons/odc | (?:open data commons attribution licen[sc]e|odc by)(?: version| v)?(?: 1 0)?
pddl-1.0 | 76 | public domain dedication/pddl | (?:public domain dedication and licen[sc]e|pddl)(?: version| v)?(?: 1 0)?
ogl-uk-3.0 | 76 | open government | open government licen[sc]e(?: for public sector information)?(?: version| v)? 3 0
ogl-uk-2.0 | 76 | open government | open government licen[sc]e(?: for public sector information)?(?: version| v)? 2 0
ogl-uk | 60 | open government | open government licen[sc]e
etalab-2.0 | 74 | etalab/licence ouverte | (?:etalab|licence ouverte)(?: open licen[sc]e)?(?: version| v)? 2 0
etalab | 60 | etalab/licence ouverte | (?:licence ouverte|etalab)
dl-de-by-2.0 | 74 | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
dl-de-zero-2.0 | 74 | datenlizenz | datenlizenz deutschland zero(?: version)?(?: 2 0)?
ofl-1.1 | 76 | open font | sil open font licen[sc]e(?: version)?(?: 1 1)?
ofl | 62 | reserved font | reserved font name
bitstream-vera | 70 | bitstream | bitstream vera is a trademark of bitstream
ubuntu-font | 70 | ubuntu font | ubuntu font licen[sc]e(?: version)?(?: 1 0)?
free-art-1.3 | 72 | free art/licence art libre | (?:free art licen[sc]e|licence art libre)(?: version)?(?: 1 3)?
against-drm | 60 | against drm | against drm licen[sc]e
dsl | 60 | design science | design science licen[sc]e
opl-1.0 | 70 | open publication | open publication licen[sc]e(?: v| version)?(?: 1 0)?
open-content | 64 | open content | open content licen[sc]e
fdl-freebsd | 66 | freebsd documentation | freebsd documentation licen[sc]e
wtfpl-2.0 | 76 | do what the/wtfpl | (?:do what the f(?:uck|ck) you want to public licen[sc]e|wtfpl)(?: version| v)? 2(?: 0)?
beerware | 72 | beerware/beer | (?:beer ?ware licen[sc]e|you can buy me a beer in return)
jdwtf | 60 | good not evil | the software shall be used for good not evil
json | 66 | json license | json licen[sc]e
hippocratic-2.1 | 70 | hippocratic | hippocratic licen[sc]e(?: version)?(?: 2 1)?
anti-996 | 70 | anti 996 | anti 996 licen[sc]e
unlicense | 78 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 74 | unlicense | (?:the unlicense|unlicense org|under the unlicense)
cc0-1.0 | 78 | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
cc0-1.0 | 78 | creativecommons | creativecommons org publicdomain zero 1 0
cc0 | 60 | cc0/cc zero/commons zero | (?:cc0|cc zero|creative commons zero)(?: universal)?
cc-pdm-1.0 | 76 | creativecommons | creativecommons org publicdomain mark 1 0
cc-pdm | 62 | public domain mark | public domain mark
cc-sampling-plus | 64 | sampling plus | (?:creative commons |cc )?sampling plus(?: 1 0)?
cc-nc | 44 | noncommercial/commercial | (?:for )?non ?commercial (?:use|purposes) only
cc | 36 | creative commons | creative commons(?: licen[sc]es?)?
public-domain | 40 | public domain | (?:in|into|to) the public domain
public-domain | 46 | public domain | dedicated to the public domain
public-domain | 46 | public domain | released (?:in)?to the public domain
public-domain | 44 | gemeinfrei/gemeinfreie/gemeinfreien/gemeinfreier/gemeinfreies | gemeinfrei(?:e[nrs]?)?
public-domain | 44 | dominio publico/dominio público | (?:de|en el|al) dominio p[uú]blico
public-domain | 44 | domaine public | (?:du|dans le) domaine public
us-government-work | 64 | government | (?:this is a |is a )?work of the (?:united states|u s|us) government
crown-copyright | 60 | crown copyright | crown copyright(?: (?:19|20)[0-9]{2})?
proprietary | 48 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 46 | proprietary | proprietary licen[sc]e
proprietary | 46 | end user | end user licen[sc]e agreement
proprietary | 46 | unauthorized/unauthorised | unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this .{1,40}? )?is (?:strictly )?prohibited
proprietary | 46 | no part of | no part of this (?:publication|work|book|document|website) may be reproduced
proprietary | 44 | without prior/without the prior | without (?:the )?prior (?:written )?permission of the (?:publisher|author|copyright (?:holder|owner)|owner)
proprietary | 40 | copied/reproduced/redistributed/republished | may not be (?:copied|reproduced|redistributed|republished)(?: or (?:copied|reproduced|redistributed|republished))*
reserved | 44 | some rights | some rights reserved
reserved | 44 | no rights | no rights reserved
reserved | 44 | alle rechte | alle rechte vorbehalten
reserved | 44 | tous droits | tous droits r[eé]serv[eé]s
reserved | 44 | todos los derechos | todos los derechos reservados
reserved | 44 | todos os direitos | todos os direitos reservados
reserved | 44 | tutti i diritti | tutti i diritti riservati
copyright | 30 | copyright | copyright(?: c| ©)? (?:19|20)[0-9]{2}
copyright | 30 | copyrighted | copyrighted(?: by| material| work)
copyright | 28 | copr | copr (?:19|20)[0-9]{2}
copyright | 30 | urheberrechtlich | urheberrechtlich gesch[uü]tzt
warranty | 24 | without warranties | without warranties or conditions of any kind
warranty | 24 | without warranty | without warranty of any kind(?: express or implied)?
warranty | 24 | without any warranty | without any warranty
warranty | 24 | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
spdx | 20 | spdx | spdx licen[sc]e identifier
"""

#: Identifiers of the SPDX list that a machine-readable line may name, in alphabetical order.
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
Beerware BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-2.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPL-1.0
ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA
NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-3.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""
