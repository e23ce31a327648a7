"""License signatures, written by hand: what licenses, notices and terms of use say.

All are regular expressions over words in lower case with one space between them.
"""

from __future__ import annotations

#: Sentences of licenses and notices: label, pattern.
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-feh", r"shall be included in all copies of the software and its documentation and acknowledgment shall be given"),
    ("x11", r"except as contained in this notice the name of (?:\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale"),
    ("json", r"the software shall be used for good not evil"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", r"this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd-2-clause-views", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", r"distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", r"historical permission notice and disclaimer"),
    ("hpnd-sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("apache-2.0", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", r"derivative works shall mean any work whether in source or object form that is based on or derived from the work"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-1.1", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("apache-1.0", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("llvm-exception", r"if you embed portions of this software which are compiled from your source code into an object form"),
    ("gpl", r"under the terms of the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl-2.0", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0-or-later", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0-or-later", r"either version 3 of the license or at your option any later version"),
    ("gpl-3.0-additional", r"additional permission under gnu (?:gpl|agpl) version 3 section 7"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", r"gcc runtime library exception"),
    ("autoconf-exception", r"as part of a program that contains a configuration script generated by autoconf"),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("openssl-exception", r"permission to link the code of (?:\S+ ){1,12}with the openssl (?:project s openssl )?library"),
    ("lgpl", r"under the terms of the gnu lesser general public license"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl-2.0", r"under the terms of the gnu library general public license"),
    ("lgpl-2.1", r"the lesser general public license applies to some specially designated software packages"),
    ("lgpl-2.1-or-later", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", r"must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gnu-license-text", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gnu-manual", r"permission is granted to make and distribute verbatim copies of this manual provided the copyright notice"),
    ("fsf-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", r"the free software foundation gives unlimited permission to copy and or distribute it"),
    ("verbatim-copying", r"verbatim copying and distribution of this entire (?:article|document|page) (?:is|are) permitted"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0-no-copyleft", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-tri-license", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-1.0", r"eclipse distribution license v ?1 0"),
    ("cpl-1.0", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", r"you can obtain a copy of the license at usr src opensolaris license"),
    ("ipl-1.0", r"ibm public license(?: version 1 0)?"),
    ("lpl-1.02", r"lucent public license"),
    ("spl-1.0", r"sun public license(?: version 1 0)?"),
    ("sissl", r"sun industry standards source license"),
    ("qpl-1.0", r"q public license(?: version 1 0)?"),
    ("rpl-1.5", r"reciprocal public license"),
    ("apsl-2.0", r"apple public source license"),
    ("nokia", r"nokia open source license"),
    ("intel", r"intel open source license"),
    ("zpl-2.1", r"zope public license"),
    ("oldap-2.8", r"openldap public license"),
    ("interbase-1.0", r"interbase public license"),
    ("opl-1.0", r"open publication license"),
    ("cpal-1.0", r"common public attribution license"),
    ("ogtsl", r"open group test suite license"),
    ("watcom-1.0", r"sybase open watcom public license"),
    ("vsl-1.0", r"vovida software license"),
    ("aal", r"attribution assurance license"),
    ("apl-1.0", r"adaptive public license"),
    ("entessa", r"entessa public license"),
    ("efl-2.0", r"eiffel forum license"),
    ("frameworx-1.0", r"frameworx open license"),
    ("liliq-p-1.1", r"licence libre du québec"),
    ("motosoto", r"motosoto open source license"),
    ("mulanpsl-2.0", r"mulan p(?:ermissive software license|sl)"),
    ("naumen", r"naumen public license"),
    ("ngpl", r"nethack general public license"),
    ("rscpl", r"ricoh source code public license"),
    ("ecl-2.0", r"educational community license"),
    ("cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("cecill", r"ce logiciel est régi par la licence cecill"),
    ("cecill-2.1", r"cecill free software license agreement"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("w3c", r"w3c software (?:and document )?notice and license"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", r"solely in the form of machine executable object code generated by a source language processor"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng-2.0", r"the png reference library is supplied as is"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", r"the freetype project license"),
    ("ftl", r"portions of this software are copyright (?:\S+ ){1,4}the freetype project"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("sleepycat", r"accompanied by information on how to obtain complete source code for the db software"),
    ("info-zip", r"info zip license"),
    ("bzip2-1.0.6", r"this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("unicode-dfs", r"unicode license agreement data files and software"),
    ("unicode-dfs", r"any person obtaining a copy of the unicode data files"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", r"verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", r"the beer ?ware license"),
    ("vim", r"vim is charityware"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", r"under the same terms as (?:the )?perl(?: 5 programming language system)? itself"),
    ("psf-2.0", r"psf is making python available to licensee on an as is basis"),
    ("psf-2.0", r"this license agreement is between the python software foundation"),
    ("beopen", r"beopen python open source license agreement"),
    ("cnri-python", r"cnri open source license agreement"),
    ("php-3.01", r"this product includes php software freely available from"),
    ("php", r"products derived from this software may not be called php"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"stimulate worldwide development of collaborative font projects"),
    ("bitstream-vera", r"any person obtaining a copy of the fonts accompanying this license"),
    ("ubuntu-font-1.0", r"ubuntu font licen[cs]e"),
    ("gust-font", r"gust font license"),
    ("lppl", r"under the conditions of the latex project public license"),
    ("lppl", r"latex project public license"),
    ("cc0-1.0", r"to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("pdm-1.0", r"identified as being free of known restrictions under copyright law"),
    ("cc-by-4.0", r"licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-3.0", r"licensed under a creative commons attribution 3 0 unported license"),
    ("cc-by-sa-4.0", r"licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("cc-by-sa-3.0", r"licensed under a creative commons attribution share ?alike 3 0 unported license"),
    ("cc-by-nc-4.0", r"licensed under a creative commons attribution non ?commercial 4 0 international license"),
    ("cc-by-nc-sa-4.0", r"licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license"),
    ("cc-by-nc-nd-4.0", r"licensed under a creative commons attribution non ?commercial no ?derivatives 4 0 international license"),
    ("cc-by-nd-4.0", r"licensed under a creative commons attribution no ?derivatives 4 0 international license"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license"),
    ("odbl-1.0", r"this (?:\S+ ){1,4}is made available under the open database license"),
    ("odbl-1.0", r"openstreetmap is open data licensed under the open data commons open database license"),
    ("dbcl-1.0", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("ogl-uk-3.0", r"contains public sector information licensed under the open government licence"),
    ("ogl", r"open government licence"),
    ("dl-de-by-2.0", r"datenlizenz deutschland (?:namensnennung|zero)"),
    ("etalab-2.0", r"licence ouverte(?: open licence)?"),
    ("cdla-permissive", r"community data license agreement permissive"),
    ("cdla-sharing", r"community data license agreement sharing"),
    ("blueoak-1.0.0", r"blue oak model license"),
    ("prosperity", r"prosperity public license"),
    ("parity", r"parity public license"),
    ("polyform-noncommercial", r"polyform noncommercial license"),
    ("polyform-small-business", r"polyform small business license"),
    ("commons-clause", r"commons clause license condition"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("busl-1.1", r"make non production use of the licensed work"),
    ("busl-1.1", r"additional use grant"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("confluent-community", r"confluent community license"),
    ("rsal", r"redis source available license"),
    ("timescale", r"timescale license agreement"),
    ("fsl", r"functional source license"),
    ("llama-3", r"(?:meta )?llama 3(?: \d)? (?:is licensed under|community license)"),
    ("llama-3", r"built with (?:meta )?llama 3"),
    ("gemma", r"(?:under and subject to the )?gemma terms of use"),
    ("qwen", r"(?:tongyi qianwen|qwen) (?:research )?license agreement"),
    ("deepseek", r"deepseek license agreement"),
    ("falcon", r"falcon (?:llm|180b tii) license"),
    ("openrail", r"you agree not to use the model or derivatives of the model"),
    ("blessing", r"the author disclaims copyright to this source code"),
    ("blessing", r"may you do good and not evil"),
    ("public-domain", r"(?:dedicated|released|placed) (?:in|in to|into|to) the public domain"),
    ("public-domain", r"this (?:work|file|image|software|code|document) is in the public domain"),
    ("us-government-work", r"work of the (?:united states|u s) government"),
    ("us-government-work", r"not subject to copyright protection (?:and is )?in the (?:united states|public domain)"),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction) of this (?:file|software|document) (?:via any medium )?is strictly prohibited"),
    ("proprietary", r"trade secrets? (?:and|or) confidential information of"),
    ("no-reproduction", r"no part of this (?:publication|document|book|work|site|software) may be reproduced"),
    ("no-reproduction", r"may not be (?:reproduced|copied|published|broadcast|rewritten) or (?:distributed|redistributed|transmitted) without (?:the )?(?:prior |express )?written (?:permission|consent)"),
    ("no-redistribution", r"redistribution (?:of this \S+ )?is (?:not permitted|prohibited)"),
    ("eula", r"end user licen[cs]e agreement"),
    ("eula", r"(?:software|product) is licensed not sold"),
    ("eula", r"by installing copying or otherwise using (?:the|this) software"),
    ("eula", r"may not reverse engineer decompile or disassemble"),
    ("freeware", r"this (?:software|program|font) is freeware"),
    ("shareware", r"this (?:software|program) is shareware"),
    ("non-commercial", r"for (?:personal and |private and )?non ?commercial use only"),
    ("non-commercial", r"free for (?:personal|private|non ?commercial) use"),
    ("research-only", r"for (?:academic|research) (?:use|purposes) only"),
    ("evaluation-only", r"for evaluation purposes only"),
    ("fair-use", r"copyrighted material the use of which has not always been specifically authorized"),
)

#: Weaker notices: label, pattern.
NOTICES = (
    ("all-rights-reserved", r"all rights reserved"),
    ("all-rights-reserved", r"alle rechte vorbehalten"),
    ("all-rights-reserved", r"tous droits réservés"),
    ("all-rights-reserved", r"todos los derechos reservados"),
    ("some-rights-reserved", r"some rights reserved"),
    ("copyright", r"copyright (?:c )?(?:\d{4}(?: \d{4})*|by)"),
    ("license-file", r"see (?:the )?(?:accompanying )?(?:license (?:file|txt|md)|file (?:license|copying))"),
    ("dual-license", r"dual licensed under"),
)

#: Names: label, name, identifier, address.
FAMILIES = (
    ("mit", r"(?:mit|expat)", "mit", "opensource org licenses mit"),
    ("mit-0", r"mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", r"apache software(?: license)?(?: version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", r"apache software(?: license)?(?: version)? 1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|old bsd)", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", "gpl", "gnu org licenses gpl"),
    ("lgpl-2.0", r"(?:gnu )?(?:library general public license|lgpl)(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", "lgpl", "gnu org licenses lgpl"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", "agpl", "gnu org licenses agpl"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: version| v)? ?1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl)", "gfdl", "gnu org (?:copyleft|licenses) fdl"),
    ("mpl-1.1", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", r"(?:mozilla public license|mpl)", "mpl", "mozilla org mpl"),
    ("epl-1.0", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: version| v)?(?: 1 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", r"(?:common development and distribution license|cddl)(?: version| v)? ?1 1", "cddl 1 1", "oracle com cddl 1 1"),
    ("cpl-1.0", r"common public license(?: version| v)? ?1 0", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("isc", r"(?:isc|internet systems consortium)", "isc", "opensource org licenses isc"),
    ("zlib", r"(?:zlib|zlib libpng)", "zlib", "opensource org licenses zlib"),
    ("bsl-1.0", r"boost software license(?: version| v)?(?: 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", r"business source license(?: version| v)?(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl", "wtfpl net"),
    ("artistic-1.0", r"(?:perl )?artistic license(?: version| v)? ?1(?: 0)?", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", r"artistic license(?: version| v)? ?2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("psf-2.0", r"python software foundation license(?: version| v)?(?: 2)?", "(?:psf|python) 2 0", "python org psf license"),
    ("php-3.01", r"php license(?: version| v)? 3 01", "php 3 01", "php net license 3 01"),
    ("ruby", r"ruby", "ruby", "ruby lang org en about license"),
    ("openssl", r"openssl", "openssl", "openssl org source license"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version| v)?(?: 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: version| v)?(?: 1 2)?", "eupl 1 2", "joinup ec europa eu collection eupl"),
    ("ms-pl", r"microsoft public license", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "ms rl", "opensource org licenses ms rl"),
    ("osl-3.0", r"open software license(?: version| v)?(?: 3 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3.0", r"academic free license(?: version| v)?(?: 3 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("odbl-1.0", r"(?:open database license|odbl)(?: version| v)?(?: 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"(?:open data commons attribution license|odc by)(?: version| v)?(?: 1 0)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", r"(?:public domain dedication and license|pddl)(?: version| v)?(?: 1 0)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1.0", r"(?:cc0|creative commons zero|cc zero)(?: version| v)?(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: license)?(?: \d \d)?(?: international| unported| generic)?", r"cc by(?: \d \d)?", "creativecommons org licenses by"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: license)?(?: \d \d)?(?: international| unported| generic)?", r"cc by sa(?: \d \d)?", "creativecommons org licenses by sa"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: license)?(?: \d \d)?(?: international| unported)?", r"cc by nd(?: \d \d)?", "creativecommons org licenses by nd"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: license)?(?: \d \d)?(?: international| unported| generic)?", r"cc by nc(?: \d \d)?", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: license)?(?: \d \d)?(?: international| unported| generic)?", r"cc by nc sa(?: \d \d)?", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: license)?(?: \d \d)?(?: international| unported)?", r"cc by nc nd(?: \d \d)?", "creativecommons org licenses by nc nd"),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?(?:open )?rail(?: m)?", "(?:bigscience |creativeml )?openrail(?: m)?", "huggingface co spaces license"),
    ("llama-2", r"llama 2 community", "llama2", "ai meta com llama license"),
    ("elastic-2.0", r"elastic license(?: version| v)? ?2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("sspl-1.0", r"(?:server side public license|sspl)(?: version| v)?(?: 1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("vim", r"vim", "vim", "vimdoc sourceforge net htmldoc uganda"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa"),
    ("upl-1.0", r"universal permissive license(?: version| v)?(?: 1 0)?", "upl 1 0", "opensource org licenses upl"),
)
