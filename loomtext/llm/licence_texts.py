"""Licence texts and notices, each with its label and its key phrases, which
must stand there (or mustn't, after an exclamation mark)."""

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""

MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""

BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""

BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""

ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
statement, including the above license grant, this restriction and the following disclaimer, must be included in all
copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

APACHE_GRANTS = """2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor
hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to
reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such
Derivative Works in Source or Object form. 3. Grant of Patent License. Subject to the terms and conditions of this
License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free,
irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and
otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that
are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to
which such Contribution(s) was submitted. If You institute patent litigation against any entity (including a cross-claim
or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct
or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall
terminate as of the date such litigation is filed. 4. Redistribution. You may reproduce and distribute copies of the
Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided
that You meet the following conditions:"""

APACHE_REST = """7. Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides
the Work (and each Contributor provides its Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT,
MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of
using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License.
8. Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or
otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing,
shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or consequential
damages of any character arising as a result of this License or out of the use or inability to use the Work"""

GNU_NOTICE = """This {thing} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU
{name} as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your option) any
later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""

GPL_PREAMBLE = """The GNU General Public License is a free, copyleft license for software and other kinds of works. The
licenses for most software and other practical works are designed to take away your freedom to share and change the
works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions
of a program--to make sure it remains free software for all its users."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""

CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and
related or neighboring rights to this work."""


def _gnu(name: str, version: str, thing: str = "program") -> str:
    return GNU_NOTICE.format(thing=thing, sep=";" if thing == "library" else ":", sep2=",", name=name, version=version)


GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

TEMPLATES = (
    ("mit", f"{MIT_GRANT} {MIT_REST}", ("permission is hereby granted", "without restriction")),
    ("mit", MIT_GRANT, ("permission is hereby granted", "without restriction")),
    ("mit-notice", "released under the MIT License", ("mit license",)),
    ("mit-notice", "licensed under the MIT License", ("mit license",)),
    ("bsd-3-clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_REST}", ("redistribution and use", "neither the name")),
    ("bsd-2-clause", f"{BSD_GRANT} {BSD_TWO} {BSD_REST}", ("redistribution and use", "binary form must reproduce", "!neither the name")),
    ("bsd", BSD_GRANT, ("redistribution and use", "conditions are met")),
    ("isc", f"{ISC_GRANT} {ISC_REST}", ("with or without fee",)),
    ("isc", ISC_GRANT, ("with or without fee",)),
    ("zlib", ZLIB, ("must not be misrepresented", "removed or altered from any source distribution")),
    ("boost-1.0", BOOST, ("any person or organization", "machine executable object code")),
    ("unlicense", UNLICENSE, ("unencumbered software", "public domain")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("apache-2.0", APACHE_NOTICE, ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", APACHE_GRANTS, ("grant of copyright license", "grant of patent license")),
    ("apache-2.0", APACHE_REST, ("disclaimer of warranty", "limitation of liability")),
    ("gpl-2.0", _gnu(GPL, "2"), ("gnu general public license", "version 2")),
    ("gpl-3.0", _gnu(GPL, "3"), ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "GNU General Public License either version 2 of the License or any later version", ("gnu general public license", "version 2")),
    ("gpl-3.0", "GNU General Public License either version 3 of the License or any later version", ("gnu general public license", "version 3")),
    ("gpl-3.0", GPL_PREAMBLE, ("gnu general public license", "copyleft license")),
    ("lgpl-2.1", _gnu(LGPL, "2.1", "library"), ("lesser general public license", "version 2 1")),
    ("lgpl-3.0", _gnu(LGPL, "3", "library"), ("lesser general public license", "version 3")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl-3.0", _gnu(AGPL, "3"), ("affero general public license", "version 3")),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", MPL_NOTICE, ("mozilla public license",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License v. 2.0", ("mozilla public license",)),
    ("epl-2.0", EPL_NOTICE, ("eclipse public license",)),
    ("cc0-1.0", CC0, ("associated cc0", "waived all copyright")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc-by", "licensed under CC BY 4.0", ("cc by 4",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced", ("all rights reserved",)),
)
