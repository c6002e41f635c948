"""Licence texts, notices and statements, each with its label and mandatory key phrase."""

_DISCLAIMER = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""

_BSD = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

TEXTS = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any", """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""),
    ("apache", "apache license", "licensed under the apache license, version 2.0"),
    ("apache", "apache license", """licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."""),
    ("apache", "terms and conditions for use reproduction and distribution", """apache license version 2.0, january 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution 1. definitions. "license" shall mean the terms and conditions for use, reproduction, and distribution as defined by sections 1 through 9 of this document. "licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the license."""),
    ("gpl", "general public license", "licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", """this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received a copy of the gnu general public license along with this program. if not, see https://www.gnu.org/licenses/"""),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", """gnu general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc. everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. preamble the gnu general public license is a free, copyleft license for software and other kinds of works."""),
    ("lgpl", "lesser general public license", """this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version. this library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu lesser general public license for more details."""),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "affero general public license", """this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version."""),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms", f"{_BSD} {_DISCLAIMER}"),
    ("bsd", "redistribution and use in source and binary forms", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}"),
    ("bsd", "bsd license", "licensed under the bsd license"),
    ("isc", "and or distribute this software for any purpose with or without fee", """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""),
    ("mpl", "mozilla public license", """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/"""),
    ("epl", "eclipse public license", """this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("unlicense", "released into the public domain", """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("cc0", "cc0 1 0 universal", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under cc0 1.0 universal"),
    ("cc-by", "creative commons attribution 4 0", "licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "attribution sharealike", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("cc-by-nc", "attribution noncommercial", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4.0"),
    ("zlib", "must not be misrepresented", """this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution."""),
    ("boost", "boost software license", "distributed under the boost software license, version 1.0. see accompanying file license_1_0.txt or copy at https://www.boost.org/license_1_0.txt"),
    ("boost", "machine executable object code", """permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("wtfpl", "do what the fuck you want to", "do what the fuck you want to public license terms and conditions for copying, distribution and modification 0. you just do what the fuck you want to."),
    ("artistic", "artistic license", "this program is free software; you can redistribute it and/or modify it under the terms of the artistic license 2.0"),
    ("postgresql", "without a written agreement", """permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."""),
    ("psf", "python software foundation", """this license agreement is between the python software foundation ("psf"), and the individual or organization ("licensee") accessing and otherwise using this software ("python") in source or binary form and its associated documentation."""),
    ("ofl", "sil open font license", "this font software is licensed under the sil open font license, version 1.1. this license is available with a faq at https://openfontlicense.org"),
)
