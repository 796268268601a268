"""Known licence sentences and the ordered rules over them (fixed values: public licence texts).

Each sentence has an identifier; a rule is a licence identifier (SPDX style) with the sentence
identifiers that must follow one another, other sentences between them allowed.
"""

#: identifier -> sentence
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-licensed": "Licensed under the ISC License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-licensed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd3-released": "Released under the BSD 3-Clause License.",
    "bsd2-released": "Released under the BSD 2-Clause License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ccby-short": "Licensed under CC BY 4.0.",
    "ccbysa-short": "Licensed under CC BY-SA 4.0.",
    "ccbync-short": "Licensed under CC BY-NC 4.0.",
    "ccbyncnd-short": "Licensed under CC BY-NC-ND 4.0.",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "reserved": "All rights reserved.",
}

#: licence, sentence identifiers in order; where two rules share sentences the longer run wins
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-disclaimer"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-project"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-licensed"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-released"]),
    ("BSD-2-Clause", ["bsd2-released"]),
    ("BSD-style", ["bsd-licensed"]),
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy", "apache-asis"]),
    ("Apache-2.0", ["apache-grant", "apache-use"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-2.1-or-later", ["lgpl-free"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-asis", "zlib-origin"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("CC-BY-4.0", ["ccby-short"]),
    ("CC-BY-SA-4.0", ["ccbysa-short"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd-short"]),
    ("CC-BY-4.0", ["ccby-work"]),
    ("CC-BY-SA-4.0", ["ccbysa-work"]),
    ("CC-BY-NC-4.0", ["ccbync-work"]),
    ("BSL-1.0", ["boost-short"]),
    ("Proprietary", ["reserved"]),
]

#: Every known sentence has one of these (lower case); texts without any of them hold no sentence.
CUES = ("licen", "copyright", "permi", "warrant", "redistribut", "public domain", "misrepresented", "all rights", "express or implied")
