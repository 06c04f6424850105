"""Public wordings of licence notices, and sentences that are none."""

from __future__ import annotations

#: Paragraphs by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, all copyright has been waived under CC0 1.0 Universal."],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "wtfpl": [
        "Published under the WTFPL.",
        "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.",
    ],
    "zlib": [
        "Licensed under the zlib License.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
}
#: SPDX identifiers by family; a line "SPDX-License-Identifier: ..." is a paragraph of it.
SPDX = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"],
    "cc0": ["CC0-1.0"], "epl": ["EPL-2.0"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"], "zlib": ["Zlib"],
}
#: Notices that many families share, or that are of none.
OTHERS = [
    "Released under the Zed Free License.", "Licensed under the Open Widget License, version 1.", "Distributed under the terms of the Example Public License.", "This work is licensed under its own license.", "SPDX-License-Identifier: LicenseRef-Example",
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
]
#: Sentences with words of licences that are none.
NEGATIVES = [
    "The driver lost the licence after the accident.", "She has a fishing license for the lake.", "Copyright law was debated in parliament.", "An apache helicopter landed near the river.", "Students at mit built a robot.", "The gnu grazed on the plain.", "Creative people met in the commons.",
    "The public domain of the park was closed.", "He rights the boat and reserved a table.", "The mozilla mascot is a dinosaur.", "Permission to land was granted.", "The version was released in may.", "Modification of the plan and redistribution of land were proposed.", "Rights reserved for members were few.",
    "The licensed plumber came at noon.", "Mit.", "Er kam mit der Bahn und ging mit dem Hund.", "Das Haus mit dem Garten.", "Mit und ohne.", "The software was installed on every computer in the office.", "Conditions at the harbour were rough and the boat stayed in port.", "A warranty covers the washing machine for two years.",
    "The eclipse was visible from the hill.", "The boost in sales surprised the owner.", "The contributors met the author of the book.", "The source of the river lies in the hills.", "Free copies were handed out to the public.", "The general spoke to the public about the plan.", "The file was sent to the printer.", "Materials for the school were provided by the town.",
    "The use of the hall is free for any purpose.", "This work was hard and the program was long.", "A copy of the letter was found in the documentation.",
]
#: Words that say nothing of licences: they are no cues.
PLAIN = "a about above all along an and any any anyone are as at be been but by can do either else even every except following for from had has have he her his i if in including into is it its limited limitation may means met more must name names neither no nor not of on one option or other otherwise own particular person persons plainly please provided purpose she should so some strictly such than that the their them they this to under unless up use used was way were what when whether which who whom will with without you your form forms later version work program file claim hope useful".split()
