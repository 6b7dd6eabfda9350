"""Licence templates: names that notices use, standard headers and grants, whole
short texts, and the full texts of ``license_data`` in passages."""

from __future__ import annotations

from pathlib import Path

# Families of licences, their versions, and the ways their names are
# written: {v} is a version, {m} one without its final ".0".
FAMILIES = {
    "Apache-{v}": (["1.0", "1.1", "2.0"], ["Apache License, Version {v}", "Apache License {v}", "Apache License version {m}", "Apache Software License {v}", "Apache Public License {v}", "Apache-{v}", "ASL {v}", "Apache {v} License"]),
    "GPL-{v}": (["1.0", "2.0", "3.0"], ["GNU General Public License, version {v}", "GNU General Public License, version {m}", "GNU General Public License {v}", "GNU General Public License v{m}", "GNU GPL version {m}", "GNU GPL v{m}", "GPL version {m}", "GPL v{m}", "GPL-{v}", "GPLv{m}"]),
    "LGPL-{v}": (["2.1", "3.0"], ["GNU Lesser General Public License, version {v}", "GNU Lesser General Public License, version {m}", "GNU Lesser General Public License {v}", "GNU Lesser General Public License v{m}", "GNU LGPL version {m}", "GNU LGPL v{m}", "LGPL version {m}", "LGPL v{m}", "LGPL-{v}", "LGPLv{m}"]),
    "LGPL-2.0": (["2.0"], ["GNU Library General Public License, version {v}", "GNU Library General Public License, version {m}", "LGPL-{v}", "LGPLv{m}"]),
    "AGPL-{v}": (["1.0", "3.0"], ["GNU Affero General Public License, version {v}", "GNU Affero General Public License, version {m}", "GNU Affero General Public License v{m}", "Affero General Public License, version {m}", "GNU AGPL version {m}", "GNU AGPL v{m}", "AGPL version {m}", "AGPL-{v}", "AGPLv{m}"]),
    "MPL-{v}": (["1.0", "1.1", "2.0"], ["Mozilla Public License, version {v}", "Mozilla Public License, v. {v}", "Mozilla Public License {v}", "MPL version {v}", "MPL {v}"]),
    "EPL-{v}": (["1.0", "2.0"], ["Eclipse Public License, version {v}", "Eclipse Public License, v. {v}", "Eclipse Public License {v}", "EPL {v}"]),
    "EUPL-{v}": (["1.1", "1.2"], ["European Union Public Licence {v}", "European Union Public License, version {v}", "EUPL {v}"]),
    "BSL-{v}": (["1.0"], ["Boost Software License, Version {v}", "Boost Software License {v}", "BSL {v}"]),
    "Artistic-{v}": (["1.0", "2.0"], ["Artistic License, version {v}", "Artistic License {v}"]),
    "BSD-{v}-Clause": (["2", "3", "4"], ["BSD {v}-Clause License", "{v}-Clause BSD License", "BSD-{v}-Clause"]),
    "BSD-2-Clause": ([""], ["Simplified BSD License", "two-clause BSD License", "FreeBSD License"]),
    "BSD-3-Clause": ([""], ["Revised BSD License", "New BSD License", "Modified BSD License", "three-clause BSD License"]),
    "BSD-4-Clause": ([""], ["Original BSD License", "four-clause BSD License"]),
    "MIT": ([""], ["MIT License", "MIT Licence", "MIT"]),
    "ISC": ([""], ["ISC License", "ISC"]),
    "Zlib": ([""], ["zlib License", "Zlib"]),
    "Unlicense": ([""], ["The Unlicense", "Unlicense"]),
    "CC0-1.0": (["1.0"], ["CC0 {v}", "CC0", "Creative Commons Zero {v}", "Creative Commons Zero v{v} Universal", "Creative Commons CC0 {v} Universal"]),
}
CC_TERMS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Files with a header of their own, in TEXTS and WHOLE below; versions must match.
HEADERS = {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"}
PASSAGE = 100


def names() -> list[tuple[str, str]]:
    """(licence, name) of every way a licence is named."""
    out = []
    for spdx, (versions, forms) in FAMILIES.items():
        for v in versions:
            plain = v.removesuffix(".0")
            out += [(spdx.format(v=v), form.format(v=v, m=plain)) for form in forms]
    for kind in CC_KINDS:
        long = "-".join(CC_TERMS[t] for t in kind.split("-"))
        apart = long.replace("NonC", "Non-C").replace("NoD", "No-D").replace("ShareA", "Share-A")
        for v in CC_VERSIONS:
            for name in (f"CC {kind} {v}", f"CC-{kind} v{v}", f"Creative Commons {long} {v}", f"Creative Commons {apart} {v}", f"Creative Commons {kind} {v}"):
                out.append((f"CC-{kind}-{v}", name))
    return list(dict.fromkeys(out))


# Standard licence texts and file headers.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD-4-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-1.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
}

_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# The texts above that stop early, to their ends, and further whole texts.
WHOLE = {
    "MIT": TEXTS["MIT"]
    + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": TEXTS["ISC"]
    + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"""{TEXTS["BSD-2-Clause"]} {_AS_IS_BSD}""",
    "BSD-3-Clause": f"""{TEXTS["BSD-3-Clause"]} {_AS_IS_BSD}""",
    "BSD-4-Clause": f"""{TEXTS["BSD-4-Clause"]} {_AS_IS_BSD}""",
    "Unlicense": TEXTS["Unlicense"]
    + """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. """
    + TEXTS["Zlib"]
    + """ If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
}


def full_texts() -> dict[str, str]:
    """The long licences, whole, by SPDX identifier."""
    folder = Path(__file__).with_name("license_data")
    return {f.stem: f.read_text() for f in sorted(folder.glob("*.txt"))}


def templates() -> list[tuple[str, str, str, str]]:
    """(template name, licence, kind, text). Kinds: ``notice``, a name that a phrase
    must come before; ``header``, of which versions must match; ``text``, a grant or
    a whole text; ``full``, a long text that is found by its passages."""
    out = [(f"{spdx} notice {k}", spdx, "notice", name) for k, (spdx, name) in enumerate(names())]
    out += [(f"{spdx} tag", spdx, "tag", f"SPDX-License-Identifier: {spdx}") for spdx in dict.fromkeys(spdx for spdx, _ in names())]
    for texts, called in ((TEXTS, "text"), (WHOLE, "whole text")):
        out += [(f"{spdx} {called}", spdx, "header" if spdx in HEADERS else "text", text) for spdx, text in texts.items()]
    return out + [(f"{spdx} full text", spdx, "full", text) for spdx, text in full_texts().items()]
