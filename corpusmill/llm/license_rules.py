r"""Signature rules of license_scan, as text: label, priority (1 is strongest), confidence, regular expression.

A rule is matched against words in lower case, joined by single spaces; what is not a letter or digit separates words. It
matches from a word's start to a word's end. Its first word is literal: it is the keyword that gates the rule.
"""

#: One rule a line. Fixed values, written by hand.
RULES = r"""
mit 1 1.0 spdx license identifier mit
mit 2 0.95 released under the mit (?:license|licence)
mit 2 0.95 licensed under the (?:terms of the )?mit (?:license|licence)
mit 3 0.9 mit (?:license|licence)
mit 3 0.8 mit licensed
mit 2 0.95 permission is hereby granted free of charge to any person obtaining a copy
mit 3 0.85 https opensource org licenses mit
mit 3 0.85 http opensource org licenses mit
mit 3 0.85 http www opensource org licenses mit license(?: php)?
mit 3 0.8 mit x11 (?:license|licence)
mit 3 0.8 expat (?:license|licence)
x11 1 1.0 spdx license identifier x11
x11 3 0.85 x11 (?:license|licence)
apache-2.0 1 1.0 spdx license identifier apache 2 0
apache-2.0 2 0.98 licensed under the apache (?:license|licence) version 2 0
apache-2.0 2 0.98 released under the apache (?:license|licence) (?:version )?2 0
apache-2.0 2 0.95 apache (?:license|licence) (?:version |v)?2 0
apache-2.0 2 0.9 apache (?:license|licence) version 2
apache-2.0 3 0.9 apache 2 0(?: license| licence| licensed)?
apache-2.0 3 0.9 apache software (?:license|licence) (?:version )?2 0
apache-2.0 3 0.9 http www apache org licenses license 2 0
apache-2.0 3 0.9 https www apache org licenses license 2 0
apache-2.0 3 0.8 asl 2 0
apache-2.0 3 0.8 al2 license
apache-1.1 1 1.0 spdx license identifier apache 1 1
apache-1.1 2 0.95 apache (?:software )?(?:license|licence) (?:version )?1 1
apache-1.0 1 1.0 spdx license identifier apache 1 0
apache-1.0 2 0.95 apache (?:software )?(?:license|licence) (?:version )?1 0
apache 4 0.7 apache (?:software )?(?:license|licence)
apache 4 0.7 apache licensed
gpl-2.0 1 1.0 spdx license identifier gpl 2 0(?: only)?
gpl-2.0 2 0.95 gnu general public license (?:as published by the free software foundation )?version 2
gpl-2.0 2 0.95 gnu gpl (?:version |v)?2
gpl-2.0 2 0.95 general public license version 2
gpl-2.0 3 0.9 gplv2
gpl-2.0 3 0.9 gpl (?:version |v)?2(?: 0)?
gpl-2.0 3 0.85 http www gnu org licenses gpl 2 0(?: html| txt)?
gpl-2.0 3 0.85 https www gnu org licenses gpl 2 0(?: html| txt)?
gpl-2.0 3 0.85 http www gnu org licenses old licenses gpl 2 0(?: html| txt)?
gpl-2.0-or-later 1 1.0 spdx license identifier gpl 2 0 or later
gpl-2.0-or-later 2 0.97 gnu general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-or-later 2 0.95 general public license version 2 or (?:at your option )?(?:any )?later
gpl-2.0-or-later 3 0.9 gplv2 or later
gpl-3.0 1 1.0 spdx license identifier gpl 3 0(?: only)?
gpl-3.0 2 0.95 gnu general public license (?:as published by the free software foundation )?version 3
gpl-3.0 2 0.95 gnu gpl (?:version |v)?3
gpl-3.0 2 0.95 general public license version 3
gpl-3.0 3 0.9 gplv3
gpl-3.0 3 0.9 gpl (?:version |v)?3(?: 0)?
gpl-3.0 3 0.85 http www gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0 3 0.85 https www gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0-or-later 1 1.0 spdx license identifier gpl 3 0 or later
gpl-3.0-or-later 2 0.97 gnu general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
gpl-3.0-or-later 2 0.95 general public license version 3 or (?:at your option )?(?:any )?later
gpl-3.0-or-later 3 0.9 gplv3 or later
gpl 4 0.75 gnu general public (?:license|licence)
gpl 4 0.7 general public (?:license|licence)
gpl 4 0.6 gnu gpl
gpl 4 0.6 gpl (?:license|licence|licensed)
lgpl-2.0 1 1.0 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 2 0.95 gnu library general public license(?: version 2(?: 0)?)?
lgpl-2.0 3 0.9 lgpl (?:version |v)?2 0
lgpl-2.1 1 1.0 spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1 2 0.95 gnu lesser general public license (?:as published by the free software foundation )?version 2 1
lgpl-2.1 2 0.95 lesser general public license version 2 1
lgpl-2.1 3 0.9 lgplv2 1
lgpl-2.1 3 0.9 lgpl (?:version |v)?2 1
lgpl-2.1 3 0.85 http www gnu org licenses lgpl 2 1(?: html| txt)?
lgpl-2.1-or-later 1 1.0 spdx license identifier lgpl 2 1 or later
lgpl-2.1-or-later 2 0.95 gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1 (?:of the license )?or (?:at your option )?any later version
lgpl-3.0 1 1.0 spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 2 0.95 gnu lesser general public license (?:as published by the free software foundation )?version 3
lgpl-3.0 2 0.95 lesser general public license version 3
lgpl-3.0 3 0.9 lgplv3
lgpl-3.0 3 0.9 lgpl (?:version |v)?3(?: 0)?
lgpl-3.0 3 0.85 http www gnu org licenses lgpl 3 0(?: html| txt)?
lgpl 4 0.75 gnu lesser general public (?:license|licence)
lgpl 4 0.7 lesser general public (?:license|licence)
lgpl 4 0.6 lgpl (?:license|licence|licensed)
agpl-3.0 1 1.0 spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 2 0.95 gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3
agpl-3.0 2 0.95 affero general public license version 3
agpl-3.0 3 0.9 agplv3
agpl-3.0 3 0.9 agpl (?:version |v)?3(?: 0)?
agpl-3.0 3 0.85 http www gnu org licenses agpl 3 0(?: html| txt)?
agpl-3.0 3 0.85 https www gnu org licenses agpl 3 0(?: html| txt)?
agpl 4 0.75 gnu affero general public (?:license|licence)
agpl 4 0.7 affero general public (?:license|licence)
agpl-1.0 1 1.0 spdx license identifier agpl 1 0(?: only| or later)?
bsd-2-clause 1 1.0 spdx license identifier bsd 2 clause
bsd-2-clause 2 0.95 bsd 2 clause(?: simplified)?(?: license| licence)?
bsd-2-clause 2 0.95 simplified bsd (?:license|licence)
bsd-2-clause 3 0.9 freebsd (?:license|licence)
bsd-2-clause 3 0.85 https opensource org licenses bsd 2 clause
bsd-2-clause 3 0.85 http opensource org licenses bsd 2 clause
bsd-2-clause 3 0.85 two clause bsd(?: license| licence)?
bsd-3-clause 1 1.0 spdx license identifier bsd 3 clause
bsd-3-clause 2 0.95 bsd 3 clause(?: new| revised)?(?: license| licence)?
bsd-3-clause 2 0.95 revised bsd (?:license|licence)
bsd-3-clause 2 0.95 modified bsd (?:license|licence)
bsd-3-clause 3 0.9 new bsd (?:license|licence)
bsd-3-clause 3 0.85 https opensource org licenses bsd 3 clause
bsd-3-clause 3 0.85 http opensource org licenses bsd 3 clause
bsd-3-clause 3 0.85 three clause bsd(?: license| licence)?
bsd-3-clause 2 0.9 neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used
bsd-4-clause 1 1.0 spdx license identifier bsd 4 clause
bsd-4-clause 2 0.95 bsd 4 clause(?: original)?(?: license| licence)?
bsd-4-clause 3 0.9 original bsd (?:license|licence)
bsd-4-clause 2 0.9 all advertising materials mentioning features or use of this software
bsd-0-clause 1 1.0 spdx license identifier 0bsd
bsd-0-clause 3 0.9 zero clause bsd(?: license| licence)?
bsd-0-clause 3 0.9 0bsd (?:license|licence)
bsd 4 0.75 bsd (?:style )?(?:license|licence)
bsd 4 0.7 bsd licensed
bsd 3 0.8 redistribution and use in source and binary forms with or without modification are permitted
isc 1 1.0 spdx license identifier isc
isc 3 0.9 isc (?:license|licence)
isc 2 0.9 permission to use copy modify and or distribute this software for any purpose
isc 3 0.85 https opensource org licenses isc
mpl-1.0 1 1.0 spdx license identifier mpl 1 0
mpl-1.0 2 0.95 mozilla public license (?:version |v)?1 0
mpl-1.1 1 1.0 spdx license identifier mpl 1 1
mpl-1.1 2 0.95 mozilla public license (?:version |v)?1 1
mpl-1.1 3 0.9 mpl (?:version |v)?1 1
mpl-2.0 1 1.0 spdx license identifier mpl 2 0
mpl-2.0 2 0.95 mozilla public license (?:version |v)?2 0
mpl-2.0 3 0.9 mpl (?:version |v)?2 0
mpl-2.0 3 0.85 https mozilla org mpl 2 0
mpl-2.0 3 0.85 http mozilla org mpl 2 0
mpl-2.0 3 0.85 https www mozilla org en us mpl 2 0
mpl 4 0.75 mozilla public (?:license|licence)
epl-1.0 1 1.0 spdx license identifier epl 1 0
epl-1.0 2 0.95 eclipse public license (?:version |v)?1 0
epl-1.0 3 0.9 epl (?:version |v)?1 0
epl-1.0 3 0.85 http www eclipse org legal epl v10(?: html)?
epl-2.0 1 1.0 spdx license identifier epl 2 0
epl-2.0 2 0.95 eclipse public license (?:version |v)?2 0
epl-2.0 3 0.9 epl (?:version |v)?2 0
epl-2.0 3 0.85 https www eclipse org legal epl 2 0
epl 4 0.75 eclipse public (?:license|licence)
edl-1.0 2 0.95 eclipse distribution license (?:version |v)?1 0
cddl-1.0 1 1.0 spdx license identifier cddl 1 0
cddl-1.0 2 0.95 common development and distribution license(?: (?:version )?1 0)?
cddl-1.0 3 0.85 cddl (?:version )?1 0
cddl-1.1 1 1.0 spdx license identifier cddl 1 1
cddl-1.1 2 0.97 common development and distribution license (?:version )?1 1
cpl-1.0 1 1.0 spdx license identifier cpl 1 0
cpl-1.0 2 0.95 common public license(?: version 1 0)?
cc0-1.0 1 1.0 spdx license identifier cc0 1 0
cc0-1.0 2 0.95 cc0 1 0(?: universal)?
cc0-1.0 2 0.95 creative commons zero(?: v?1 0)?
cc0-1.0 3 0.85 cc0 (?:license|licence|public domain dedication)
cc0-1.0 3 0.9 https creativecommons org publicdomain zero 1 0
cc0-1.0 3 0.9 http creativecommons org publicdomain zero 1 0
cc-by-2.0 2 0.95 creative commons attribution 2 0(?: generic)?
cc-by-2.0 3 0.9 cc by 2 0
cc-by-3.0 1 1.0 spdx license identifier cc by 3 0
cc-by-3.0 2 0.95 creative commons attribution 3 0(?: unported)?
cc-by-3.0 3 0.9 cc by 3 0
cc-by-3.0 3 0.9 https creativecommons org licenses by 3 0
cc-by-4.0 1 1.0 spdx license identifier cc by 4 0
cc-by-4.0 2 0.95 creative commons attribution 4 0(?: international)?
cc-by-4.0 3 0.9 cc by 4 0
cc-by-4.0 3 0.9 https creativecommons org licenses by 4 0
cc-by-4.0 3 0.9 http creativecommons org licenses by 4 0
cc-by-sa-2.0 3 0.9 cc by sa 2 0
cc-by-sa-3.0 1 1.0 spdx license identifier cc by sa 3 0
cc-by-sa-3.0 2 0.95 creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-3.0 3 0.9 cc by sa 3 0
cc-by-sa-3.0 3 0.9 https creativecommons org licenses by sa 3 0
cc-by-sa-4.0 1 1.0 spdx license identifier cc by sa 4 0
cc-by-sa-4.0 2 0.95 creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-4.0 3 0.9 cc by sa 4 0
cc-by-sa-4.0 3 0.9 https creativecommons org licenses by sa 4 0
cc-by-nc-3.0 3 0.9 cc by nc 3 0
cc-by-nc-4.0 1 1.0 spdx license identifier cc by nc 4 0
cc-by-nc-4.0 2 0.95 creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-4.0 3 0.9 cc by nc 4 0
cc-by-nc-4.0 3 0.9 https creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 1 1.0 spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 2 0.95 creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa-4.0 3 0.9 cc by nc sa 4 0
cc-by-nc-sa-4.0 3 0.9 https creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 1 1.0 spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 2 0.95 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-nd-4.0 3 0.9 cc by nc nd 4 0
cc-by-nd-4.0 1 1.0 spdx license identifier cc by nd 4 0
cc-by-nd-4.0 2 0.95 creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nd-4.0 3 0.9 cc by nd 4 0
cc 4 0.7 creative commons (?:attribution )?(?:license|licence)
unlicense 1 1.0 spdx license identifier unlicense
unlicense 3 0.9 unlicense org
unlicense 2 0.9 free and unencumbered software released into the public domain
unlicense 3 0.85 https unlicense org
wtfpl 1 1.0 spdx license identifier wtfpl
wtfpl 2 0.9 do what the fuck you want to public license
wtfpl 3 0.85 wtfpl (?:license|licence|version 2)
zlib 1 1.0 spdx license identifier zlib
zlib 3 0.9 zlib (?:libpng )?(?:license|licence)
zlib 3 0.85 zlib libpng
zlib 2 0.9 altered source versions must be plainly marked as such
libpng 1 1.0 spdx license identifier libpng(?: 2 0)?
libpng 3 0.9 libpng (?:license|licence)
bsl-1.0 1 1.0 spdx license identifier bsl 1 0
bsl-1.0 2 0.95 boost software license(?: version 1 0)?
bsl-1.0 3 0.85 http www boost org license 1 0 txt
bsl-1.0 3 0.85 https www boost org license 1 0 txt
artistic-1.0 1 1.0 spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1.0 2 0.95 artistic license 1 0
artistic-2.0 1 1.0 spdx license identifier artistic 2 0
artistic-2.0 2 0.95 artistic license 2 0
artistic 4 0.75 artistic (?:license|licence)
perl 3 0.8 perl artistic license
python-2.0 1 1.0 spdx license identifier (?:python|psf) 2 0
python-2.0 2 0.95 python software foundation (?:license|licence)(?: version 2)?
python-2.0 3 0.85 psf (?:license|licence)
php-3.01 1 1.0 spdx license identifier php 3 01
php-3.01 2 0.95 php license version 3 01
php 4 0.75 php (?:license|licence)
ruby 1 1.0 spdx license identifier ruby
ruby 3 0.85 ruby (?:license|licence)
postgresql 1 1.0 spdx license identifier postgresql
postgresql 3 0.9 postgresql (?:license|licence)
openssl 1 1.0 spdx license identifier openssl
openssl 3 0.9 openssl (?:license|licence)
ofl-1.1 1 1.0 spdx license identifier ofl 1 1
ofl-1.1 2 0.95 sil open font license(?: (?:version )?1 1)?
ofl-1.1 3 0.85 open font license
ofl-1.1 3 0.85 http scripts sil org ofl
eupl-1.1 1 1.0 spdx license identifier eupl 1 1
eupl-1.1 2 0.95 european union public licence (?:v )?1 1
eupl-1.2 1 1.0 spdx license identifier eupl 1 2
eupl-1.2 2 0.95 european union public licence (?:v )?1 2
eupl 4 0.75 european union public (?:licence|license)
cecill-2.1 1 1.0 spdx license identifier cecill 2 1
cecill 3 0.85 cecill (?:b |c )?(?:license|licence|free software license agreement)
osl-3.0 1 1.0 spdx license identifier osl 3 0
osl-3.0 2 0.95 open software license(?: version)? 3 0
afl-3.0 1 1.0 spdx license identifier afl 3 0
afl-3.0 2 0.95 academic free license(?: version)? 3 0
ms-pl 1 1.0 spdx license identifier ms pl
ms-pl 2 0.95 microsoft public license(?: ms pl)?
ms-rl 1 1.0 spdx license identifier ms rl
ms-rl 2 0.95 microsoft reciprocal license(?: ms rl)?
ncsa 1 1.0 spdx license identifier ncsa
ncsa 2 0.95 university of illinois ncsa open source license
ncsa 3 0.85 ncsa open source license
w3c 1 1.0 spdx license identifier w3c
w3c 2 0.95 w3c software (?:notice and )?license
odbl-1.0 1 1.0 spdx license identifier odbl 1 0
odbl-1.0 2 0.95 open database license(?: odbl)?(?: v?1 0)?
odc-by-1.0 1 1.0 spdx license identifier odc by 1 0
odc-by-1.0 2 0.95 open data commons attribution license(?: v?1 0)?
pddl-1.0 2 0.95 open data commons public domain dedication and license
gfdl-1.3 1 1.0 spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 2 0.95 gnu free documentation license (?:version )?1 3
gfdl-1.2 2 0.95 gnu free documentation license (?:version )?1 2
gfdl 4 0.75 gnu free documentation (?:license|licence)
llama 2 0.9 llama [234](?: \d)? community license(?: agreement)?
openrail 2 0.9 creativeml open ?rail m(?: license)?
openrail 3 0.85 bigscience (?:open)?rail (?:m )?(?:license|licence)
elastic-2.0 1 1.0 spdx license identifier elastic 2 0
elastic-2.0 2 0.95 elastic license (?:version |v)?2(?: 0)?
sspl-1.0 1 1.0 spdx license identifier sspl 1 0
sspl-1.0 2 0.95 server side public license(?: version 1)?
busl-1.1 1 1.0 spdx license identifier busl 1 1
busl-1.1 2 0.95 business source license(?: version)? 1 1
public-domain 3 0.8 dedicated to the public domain
public-domain 3 0.8 released into the public domain
proprietary 4 0.5 all rights reserved
proprietary 3 0.7 proprietary and confidential
proprietary 3 0.7 unauthorized copying of this file
""".strip()
