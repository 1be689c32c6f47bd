"""Signature rules of the license scan, in the order of their priority.

A rule is ``label : keyword : pattern``. Patterns are matched against the words
of a text in lower case, joined by single spaces, and begin and end at words:
``Version 2.0`` reads ``version 2 0``. A rule is tried only where its keyword,
a literal part of whatever the pattern matches, occurs. Sections run from what
says most to what says least, and inside a section the narrower rule comes
first.
"""

from __future__ import annotations

#: Sentences of the license texts themselves.
CLAUSES = r"""
mit : permission is hereby granted : permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit : shall be included in all copies : the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 : permission is hereby granted free of charge : permission is hereby granted free of charge to any person obtaining a copy (?:\w+ ){8,30}without restriction (?:\w+ ){0,12}no conditions
isc : with or without fee : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd : with or without fee is hereby granted : permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-3-clause : to endorse or promote : neither the names? of (?:\w+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd-4-clause : advertising materials mentioning : all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause : redistributions in binary form : redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause : redistributions of source code : redistributions of source code must retain the above copyright notice this list of conditions
apache-2.0 : reproduce prepare derivative works : perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works
apache-2.0 : you may not use this file except : you may not use this file except in compliance with the license
apache-1.1 : product includes software developed by the apache : this product includes software developed by the apache (?:software foundation|group)
gpl-3.0 : free software foundation either version 3 : terms of the gnu general public license as published by the free software foundation either version 3
gpl-2.0 : free software foundation either version 2 : terms of the gnu general public license as published by the free software foundation either version 2
gpl-1.0 : free software foundation either version 1 : terms of the gnu general public license as published by the free software foundation either version 1
lgpl-3.0 : lesser general public license as published : terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1 : lesser general public license as published : terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2.0 : library general public license as published : terms of the gnu library general public license as published by the free software foundation either version 2
agpl-3.0 : affero general public license as published : terms of the gnu affero general public license as published by the free software foundation either version 3
gfdl : with no invariant sections : with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts
gfdl-1.3 : free documentation license version 1 3 : copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 : free documentation license version 1 2 : copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.1 : free documentation license version 1 1 : copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1
mpl-2.0 : mozilla public license v 2 0 : this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 : mozilla public license version 1 1 : the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 : mozilla public license version 1 0 : the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 : netscape public license : the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 : common development and distribution license : the contents of this file are subject to the terms of the common development and distribution license
epl-2.0 : eclipse public license 2 0 : made available under the terms of the eclipse public license 2 0
epl-1.0 : eclipse public license v1 0 : made available under the terms of the eclipse public license v1 0
bsl-1.0 : software and accompanying documentation covered : obtaining a copy of the software and accompanying documentation covered by this license
zlib : altered source versions : altered source versions must be plainly marked as such and must not be misrepresented
zlib : origin of this software must not : the origin of this software must not be misrepresented
unlicense : free and unencumbered : this is free and unencumbered software released into the public domain
wtfpl : what the fuck you want : you just do what the fuck you want to
ofl-1.1 : reserved font name : with reserved font name
ofl-1.1 : font software : the font software may be sold as part of a larger software package
artistic-2.0 : standard version : you are permitted to use the standard version and create and use modified versions for any purpose
php-3.01 : this product includes php : this product includes php software freely available from
openssl : openssl toolkit : software developed by the openssl project for use in the openssl toolkit
ssleay : cryptographic software written by eric young : this product includes cryptographic software written by eric young
json : used for good not evil : the software shall be used for good not evil
beerware : buy me a beer : (?:you can|and you think this stuff is worth it you can) buy me a beer
cc0-1.0 : all copyright and related : waived? all copyright and related or neighboring rights
cc0-1.0 : affirmer hereby overtly : affirmer hereby overtly fully permanently irrevocably and unconditionally waives
unicode-dfs : data files or software : provided that either this copyright and permission notice appear with all copies of the data files or software
x11 : shall not be used in advertising : shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
hpnd : supporting documentation : that both that copyright notice and this permission notice appear in supporting documentation
python-2.0 : psf is making python available : psf is making python available to licensee on an as is basis
w3c : w3c software notice : w3c software notice and license
ncsa : names of its contributors may be used to endorse or promote products derived from this software without specific : neither the names of (?:\w+ ){1,16}nor the names of its contributors may be used to endorse or promote products derived from this software without specific
postgresql : without a written agreement : without fee and without a written agreement is hereby granted
no-commercial : for non commercial purposes only : (?:use|used|provided|available|licensed) for non commercial purposes only
no-redistribution : may not be redistributed : may not be redistributed (?:in any form )?without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)
"""

#: Notices that name the license a work is under.
NOTICES = r"""
apache-2.0 : apache license version 2 : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache license version 2(?: 0)?
apache-1.1 : apache license version 1 1 : (?:licensed|released|distributed|available) under (?:the )?apache license version 1 1
apache-1.0 : apache license version 1 0 : (?:licensed|released|distributed|available) under (?:the )?apache license version 1 0
apache-2.0 : apache 2 0 license : (?:licensed|released|distributed|available) under (?:the )?apache 2 0 license
mit : mit license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
isc : isc license : (?:licensed|released|distributed|available) under (?:the )?isc license
bsd-2-clause : bsd license : (?:licensed|released|distributed|available) under (?:the |a )?(?:2 clause|two clause|simplified) bsd license
bsd-3-clause : bsd license : (?:licensed|released|distributed|available) under (?:the |a )?(?:3 clause|three clause|new|modified|revised) bsd license
bsd-4-clause : bsd license : (?:licensed|released|distributed|available) under (?:the |a )?(?:4 clause|four clause|original|old) bsd license
bsd : bsd style license : (?:licensed|released|distributed|available|governed) (?:under|by) a bsd style license
bsd : bsd license : (?:licensed|released|distributed|available) under (?:the |a )?bsd license
agpl-3.0 : gnu affero general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu affero general public license (?:version |v )?3(?: 0)?
agpl : gnu affero general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu affero general public license
lgpl-3.0 : gnu lesser general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public license (?:version |v )?3(?: 0)?
lgpl-2.1 : gnu lesser general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public license (?:version |v )?2 1
lgpl : gnu lesser general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public license
gpl-3.0-or-later : any later version : gnu general public license (?:version |v )?3(?: 0)? or (?:at your option )?any later version
gpl-2.0-or-later : any later version : gnu general public license (?:version |v )?2(?: 0)? or (?:at your option )?any later version
gpl-3.0 : gnu general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public license (?:version |v )?3(?: 0)?
gpl-2.0 : gnu general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public license (?:version |v )?2(?: 0)?
gpl-any : gnu general public license : (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu general public license
mpl-2.0 : mozilla public license : (?:licensed|released|distributed|available) under (?:the )?mozilla public license (?:version |v )?2(?: 0)?
mpl : mozilla public license : (?:licensed|released|distributed|available) under (?:the )?mozilla public license
epl-2.0 : eclipse public license : (?:licensed|released|distributed|available) under (?:the )?eclipse public license (?:version |v )?2(?: 0)?
epl-1.0 : eclipse public license : (?:licensed|released|distributed|available) under (?:the )?eclipse public license (?:version |v )?1(?: 0)?
cc-by-nc-nd-4.0 : cc by nc nd 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by nc nd 4 0
cc-by-nc-sa-4.0 : cc by nc sa 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by nc sa 4 0
cc-by-nc-4.0 : cc by nc 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by nc 4 0
cc-by-nd-4.0 : cc by nd 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by nd 4 0
cc-by-sa-4.0 : cc by sa 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by sa 4 0
cc-by-4.0 : cc by 4 0 : (?:licensed|released|distributed|available|shared) under (?:a |the )?cc by 4 0
cc-by-nc-nd : noncommercial noderiv : creative commons attribution noncommercial noderiv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nc-nd : non commercial no deriv : creative commons attribution non commercial no deriv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nc-sa : noncommercial sharealike : creative commons attribution noncommercial sharealike(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nc-sa : non commercial share alike : creative commons attribution non commercial share alike(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nc : attribution noncommercial : creative commons attribution noncommercial(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nc : attribution non commercial : creative commons attribution non commercial(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nd : attribution noderiv : creative commons attribution noderiv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-nd : attribution no deriv : creative commons attribution no deriv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-sa : attribution sharealike : creative commons attribution sharealike(?: \d \d)?(?: international| unported)?(?: license)?
cc-by-sa : attribution share alike : creative commons attribution share alike(?: \d \d)?(?: international| unported)?(?: license)?
cc-by : creative commons attribution : creative commons attribution(?: \d \d)?(?: international| unported)?(?: license)?
cc0-1.0 : creative commons zero : creative commons zero(?: v?1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 : cc0 : (?:licensed|released|distributed|available|dedicated) (?:under|to|using) (?:the )?cc0(?: 1 0)?(?: universal)?
odbl-1.0 : open database license : (?:licensed|released|distributed|available) under (?:the )?open database license
ogl-uk : open government licence : (?:contains|licensed|published|available) (?:\w+ ){0,8}under the open government licence(?: v\d 0)?
cdla-permissive : community data license agreement permissive : (?:licensed|released|available) under (?:the )?community data license agreement permissive
cdla-sharing : community data license agreement sharing : (?:licensed|released|available) under (?:the )?community data license agreement sharing
pddl-1.0 : public domain dedication and license : (?:licensed|released|available) under (?:the )?(?:open data commons )?public domain dedication and license
public-domain : public domain : (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain : public domain : this (?:work|file|text|document|software|book|image) is (?:in|part of) the public domain
proprietary : confidential and proprietary : confidential and proprietary
proprietary : proprietary license : (?:licensed|released|distributed|available) under (?:a |the )?proprietary license
proprietary : unauthorized copying : unauthorized copying of this (?:file|work|document|software)(?: via any medium)? is strictly prohibited
proprietary : no part of this : no part of this (?:publication|book|work|document|site|website) may be (?:reproduced|copied|distributed|transmitted|stored)
proprietary : reproduction : reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is (?:strictly )?(?:prohibited|forbidden)
dual : dual licensed under : dual licensed under (?:the )?(?:\w+ ){1,6}(?:and|or) (?:the )?\w+
terms : subject to the terms and conditions : subject to the terms and conditions of (?:this|the) (?:license|agreement)
terms : by downloading : by downloading (?:\w+ ){1,8}you agree to (?:the|these|our) terms
permission : permission : (?:reprinted|reproduced|used) (?:here )?with (?:the )?(?:kind )?permission
permission : by permission of : (?:reprinted|reproduced|used) by permission of
copyright : all rights reserved : (?:copyright|c) (?:19|20)\d\d(?: (?:19|20)\d\d)? (?:\w+ ){1,6}all rights reserved
copyright : copyright : copyright (?:c )?(?:by )?(?:19|20)\d\d
copyright : copyright : copyright (?:c )?\w+ (?:\w+ ){0,3}(?:19|20)\d\d
copyright-de : alle rechte vorbehalten : alle rechte vorbehalten
copyright-fr : tous droits : tous droits (?:réservés|reserves)
copyright-es : todos los derechos reservados : todos los derechos reservados
copyright-it : tutti i diritti riservati : tutti i diritti riservati
copyright-pt : todos os direitos reservados : todos os direitos reservados
copyright-nl : alle rechten voorbehouden : alle rechten voorbehouden
copyright-pl : wszelkie prawa zastrzeżone : wszelkie prawa zastrzeżone
copyright-some : some rights reserved : some rights reserved
copyright-no : no rights reserved : no rights reserved
"""

#: Names of licenses.
NAMES = r"""
apache-2.0 : apache license : apache license (?:version |v )?2(?: 0)?
apache-1.1 : apache license : apache license (?:version |v )?1 1
apache-1.0 : apache license : apache license (?:version |v )?1 0
apache-1.1 : apache software license : apache software license (?:version |v )?1 1
apache-any : apache software license : apache software license
apache-any : apache license : apache license
afl-3.0 : academic free license : academic free license (?:version |v )?3(?: 0)?
afl-2.1 : academic free license : academic free license (?:version |v )?2 1
afl : academic free license : academic free license
apsl-2.0 : apple public source license : apple public source license(?: (?:version |v )?2(?: 0)?)?
artistic-2.0 : artistic license : artistic license (?:version |v )?2(?: 0)?
artistic-1.0 : artistic license : artistic license (?:version |v )?1(?: 0)?
artistic : artistic license : artistic license
agpl-3.0 : affero general public license : affero general public license (?:version |v )?3(?: 0)?
agpl-1.0 : affero general public license : affero general public license (?:version |v )?1(?: 0)?
agpl : affero general public license : affero general public license
lgpl-3.0 : lesser general public license : lesser general public license (?:version |v )?3(?: 0)?
lgpl-2.1 : lesser general public license : lesser general public license (?:version |v )?2 1
lgpl : lesser general public license : lesser general public license
lgpl-2.0 : library general public license : library general public license(?: (?:version |v )?2(?: 0)?)?
gpl-3.0 : general public license : (?:gnu )?general public license (?:version |v )?3(?: 0)?
gpl-2.0 : general public license : (?:gnu )?general public license (?:version |v )?2(?: 0)?
gpl-1.0 : general public license : (?:gnu )?general public license (?:version |v )?1(?: 0)?
gpl-any : general public license : (?:gnu )?general public license
gpl-any : general public licence : (?:gnu )?general public licence
gfdl-1.3 : free documentation license : (?:gnu )?free documentation license (?:version |v )?1 3
gfdl-1.2 : free documentation license : (?:gnu )?free documentation license (?:version |v )?1 2
gfdl : free documentation license : (?:gnu )?free documentation license
mit-0 : mit no attribution : mit no attribution
mit : mit license : mit license
mit : mit licence : mit licence
mit : expat license : expat license
x11 : x11 license : x11 license
isc : isc license : isc license
0bsd : zero clause bsd : zero clause bsd(?: license)?
0bsd : 0 clause bsd : 0 clause bsd(?: license)?
bsd-2-clause : clause bsd : (?:2|two) clause bsd(?: license)?
bsd-3-clause : clause bsd : (?:3|three) clause bsd(?: license)?
bsd-4-clause : clause bsd : (?:4|four) clause bsd(?: license)?
bsd-2-clause : simplified bsd license : simplified bsd license
bsd-2-clause : freebsd license : freebsd license
bsd-3-clause : new bsd license : new bsd license
bsd-3-clause : modified bsd license : modified bsd license
bsd-3-clause : revised bsd license : revised bsd license
bsd-2-clause-patent : plus patent license : bsd 2 clause plus patent license
bsd : bsd style : bsd style license
bsd : bsd license : bsd license
bsl-1.0 : boost software license : boost software license(?: (?:version )?1 0)?
busl-1.1 : business source license : business source license(?: (?:version )?1 1)?
cc0-1.0 : cc0 : cc0 1 0(?: universal)?
cc-by-nc-nd : attribution noncommercial noderiv : attribution noncommercial noderiv(?:ative)?s
cc-by-nc-sa : attribution noncommercial sharealike : attribution noncommercial sharealike
cc-by-nc : attribution noncommercial : attribution noncommercial
cc-by-nd : attribution noderiv : attribution noderiv(?:ative)?s
cc-by-sa : attribution sharealike : attribution sharealike
cc-any : creative commons license : creative commons license
cc-any : creative commons licence : creative commons licence
cecill-2.1 : cecill : cecill (?:version |v )?2 1
cecill-b : cecill b : cecill b
cecill-c : cecill c : cecill c
cddl-1.1 : common development and distribution license : common development and distribution license (?:version |v )?1 1
cddl-1.0 : common development and distribution license : common development and distribution license
cpl-1.0 : common public license : common public license(?: (?:version |v )?1 0)?
cpal-1.0 : common public attribution license : common public attribution license(?: (?:version |v )?1 0)?
ecl-2.0 : educational community license : educational community license(?: (?:version )?2 0)?
efl-2.0 : eiffel forum license : eiffel forum license(?: (?:version )?2)?
epl-2.0 : eclipse public license : eclipse public license (?:version |v )?2(?: 0)?
epl-1.0 : eclipse public license : eclipse public license
edl-1.0 : eclipse distribution license : eclipse distribution license(?: v ?1 0)?
eupl-1.2 : european union public licen : european union public licen[cs]e (?:version |v )?1 2
eupl-1.1 : european union public licen : european union public licen[cs]e (?:version |v )?1 1
eupl : european union public licen : european union public licen[cs]e
elastic-2.0 : elastic license : elastic license(?: (?:version )?2 0)?
hpnd : historical permission notice : historical permission notice and disclaimer
ipl-1.0 : ibm public license : ibm public license(?: (?:version )?1 0)?
ijg : independent jpeg group : independent jpeg group license
imagemagick : imagemagick license : imagemagick license
intel-acpi : intel acpi : intel acpi software license agreement
lppl-1.3c : latex project public license : latex project public license(?: (?:version |v )?1 3c?)?
lpl-1.02 : lucent public license : lucent public license(?: (?:version |v )?1 02)?
ms-pl : microsoft public license : microsoft public license
ms-rl : microsoft reciprocal license : microsoft reciprocal license
miros : miros licen : miros licen[cs]e
motosoto : motosoto : motosoto open source license
mpl-2.0 : mozilla public license : mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 : mozilla public license : mozilla public license (?:version |v )?1 1
mpl : mozilla public license : mozilla public license
mulan-psl-2.0 : mulan permissive software license : mulan permissive software license(?: (?:version |v )?2)?
nasa-1.3 : nasa open source agreement : nasa open source agreement(?: (?:version )?1 3)?
naumen : naumen public license : naumen public license
ncsa : illinois ncsa : university of illinois ncsa open source license
nokia : nokia open source license : nokia open source license
nposl-3.0 : non profit open software license : non profit open software license(?: 3 0)?
ntp : ntp license : ntp license
odbl-1.0 : open database license : open database license
odc-by-1.0 : open data commons attribution license : open data commons attribution license
pddl-1.0 : public domain dedication and license : open data commons public domain dedication and license
ofl-1.1 : open font license : (?:sil )?open font license(?: (?:version )?1 1)?
ofl-1.1 : sil ofl : sil ofl(?: 1 1)?
oclc-2.0 : oclc research public license : oclc research public license(?: 2 0)?
oldap-2.8 : openldap public license : openldap public license(?: (?:version )?2 8)?
openssl : openssl license : openssl license
osl-3.0 : open software license : open software license (?:version |v )?3(?: 0)?
osl : open software license : open software license
parity-7.0 : parity public license : parity public license(?: 7 0 0)?
php-3.01 : php license : php license(?: (?:version )?3 01)?
polyform-noncommercial : polyform noncommercial : polyform noncommercial license
polyform-shield : polyform shield : polyform shield license
polyform-small : polyform small business : polyform small business license
postgresql : postgresql licen : postgresql licen[cs]e
python-2.0 : python software foundation license : python software foundation license
python-2.0 : psf license : psf license(?: agreement)?
qpl-1.0 : q public license : q public license(?: (?:version )?1 0)?
rpl-1.5 : reciprocal public license : reciprocal public license(?: 1 5)?
rpsl-1.0 : realnetworks public source license : realnetworks public source license
ruby : ruby license : ruby license
sspl-1.0 : server side public license : server side public license(?: (?:version |v )?1)?
simpl-2.0 : simple public license : simple public license(?: 2 0)?
sleepycat : sleepycat license : sleepycat license
spl-1.0 : sun public license : sun public license(?: (?:version |v )?1 0)?
sissl : sun industry standards source license : sun industry standards source license
unicode-dfs : unicode license agreement : unicode license agreement
unlicense : the unlicense : the unlicense
upl-1.0 : universal permissive license : universal permissive license(?: (?:version |v )?1 0)?
vim : vim license : vim license
vsl-1.0 : vovida software license : vovida software license
w3c : w3c software : w3c software (?:notice and )?license
watcom-1.0 : sybase open watcom : sybase open watcom public license
wtfpl : do what the fuck : do what the fuck you want to public license
xnet : x net license : x net license
zlib-acknowledgement : zlib libpng license with acknowledg : zlib libpng license with acknowledge?ment
zlib : zlib license : zlib license
zlib : zlib libpng license : zlib libpng license
zpl-2.1 : zope public license : zope public license(?: (?:version |v )?2 1)?
openrail : openrail : (?:creativeml |bigscience |bigcode )?openrail(?: [md])?(?: license)?
llama : community license agreement : llama \d (?:\d )?community license agreement
gutenberg : project gutenberg license : (?:full )?project gutenberg license
crown : crown copyright : crown copyright
etalab-2.0 : licence ouverte : (?:etalab )?licence ouverte(?: (?:version )?2 0)?
dl-de-by-2.0 : datenlizenz deutschland : datenlizenz deutschland namensnennung(?: (?:version )?2 0)?
dl-de-zero-2.0 : datenlizenz deutschland : datenlizenz deutschland zero(?: (?:version )?2 0)?
"""

#: Short names and tags, as in file headers.
TAGS = r"""
spdx : spdx license identifier : spdx license identifier \w+(?: \d)*
cc-by-nc-nd : cc by nc nd : cc by nc nd(?: \d \d)?
cc-by-nc-sa : cc by nc sa : cc by nc sa(?: \d \d)?
cc-by-nc : cc by nc : cc by nc(?: \d \d)?
cc-by-nd : cc by nd : cc by nd(?: \d \d)?
cc-by-sa : cc by sa : cc by sa(?: \d \d)?
cc-by : cc by : cc by(?: \d \d)?
cc0-1.0 : cc0 : cc0
agpl-3.0 : agpl : agpl ?v?3(?: 0)?(?: only| or later)?
agpl : agpl : agplv?\d?
lgpl-3.0 : lgpl : lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1 : lgpl : lgpl ?v?2 1(?: only| or later)?
lgpl : lgpl : lgplv?\d?
gpl-3.0 : gpl : gpl ?v?3(?: 0)?(?: only| or later)?
gpl-2.0 : gpl : gpl ?v?2(?: 0)?(?: only| or later)?
gpl-any : gpl : gpl
gfdl : gfdl : gfdl
apache-2.0 : apache 2 0 : apache 2 0
bsd-2-clause : bsd 2 clause : bsd 2 clause
bsd-3-clause : bsd 3 clause : bsd 3 clause
bsd-4-clause : bsd 4 clause : bsd 4 clause
0bsd : 0bsd : 0bsd
mpl-2.0 : mpl 2 0 : mpl 2 0
mpl-1.1 : mpl 1 1 : mpl 1 1
epl-2.0 : epl 2 0 : epl 2 0
epl-1.0 : epl 1 0 : epl 1 0
eupl-1.2 : eupl 1 2 : eupl 1 2
eupl-1.1 : eupl 1 1 : eupl 1 1
cddl-1.0 : cddl 1 0 : cddl 1 0
cddl : cddl : cddl
bsl-1.0 : bsl 1 0 : bsl 1 0
busl-1.1 : busl 1 1 : busl 1 1
sspl-1.0 : sspl : sspl(?: 1 0)?
odbl-1.0 : odbl : odbl(?: 1 0)?
wtfpl : wtfpl : wtfpl
ms-pl : ms pl : ms pl
ms-rl : ms rl : ms rl
ofl-1.1 : ofl 1 1 : ofl 1 1
cecill : cecill : cecill
reserved : all rights reserved : all rights reserved
license-url : opensource org licenses : (?:https? )?(?:www )?opensource org licenses \w+
license-url : creativecommons org : (?:https? )?(?:www )?creativecommons org (?:licenses|publicdomain)(?: \w+){0,4}
license-url : gnu org licenses : (?:https? )?(?:www )?gnu org licenses \w+
license-url : apache org licenses : (?:https? )?(?:www )?apache org licenses \w+(?: \d \d)?
license-file : license txt : license txt
license-file : license md : license md
license-file : copying : see (?:the )?(?:file )?copying
license-file : license file : (?:see|in) the license file
"""

#: Sections in their order, with what a detection of each is worth.
SECTIONS = ((CLAUSES, 1.0), (NOTICES, 0.95), (NAMES, 0.8), (TAGS, 0.6))
