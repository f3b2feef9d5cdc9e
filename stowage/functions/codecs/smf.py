"""Standard MIDI files: events to and from bytes, and notes in seconds."""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np

from ...errors import ReadError

NOTE_DTYPE = np.dtype([("onset", "f8"), ("offset", "f8"), ("pitch", "i2"), ("velocity", "i2"), ("program", "i2"), ("is_drum", "?"), ("instrument", "i2")])
DRUM_CHANNEL = 9


@dataclass
class Instrument:
    """What one program plays on one channel of one track; times are in seconds."""

    program: int = 0
    is_drum: bool = False
    name: str = ""
    notes: list[tuple[float, float, int, int]] = field(default_factory=list)  # onset, offset, pitch, velocity
    controls: list[tuple[float, int, int]] = field(default_factory=list)  # time, number, value
    bends: list[tuple[float, int]] = field(default_factory=list)  # time, value between -8192 and 8191


@dataclass
class Song:
    resolution: int = 480
    tempos: list[tuple[float, float]] = field(default_factory=list)  # time, beats a minute
    time_signatures: list[tuple[float, int, int]] = field(default_factory=list)
    key_signatures: list[tuple[float, int, bool]] = field(default_factory=list)  # time, sharps, minor
    instruments: list[Instrument] = field(default_factory=list)

    @property
    def end(self) -> float:
        times = [0.0]
        for i in self.instruments:
            times += [n[1] for n in i.notes] + [c[0] for c in i.controls] + [b[0] for b in i.bends]
        return max(times)


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        if at >= len(raw):
            raise ReadError("a MIDI track is cut short")
        value = value << 7 | raw[at] & 127
        at += 1
        if not raw[at - 1] & 128:
            return value, at
    raise ReadError("a MIDI number is too long")


def _plain(body: bytes, begin: int, track: int, first: int) -> list[tuple] | None:
    """The events of a track that says every status and has no others than notes, programs, controls and the like and short
    names and signatures, as most have; None if it may be another.

    What would follow each byte, if an event began there, is worked out for all bytes at once.
    """
    size = len(body) - begin
    if size < 64:
        return None
    raw = np.frombuffer(body, np.uint8, offset=begin)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.int64)
    a, b, c, d = (raw[k : size + k] for k in range(4))
    width = np.where(a < 128, 1, np.where(b < 128, 2, np.where(c < 128, 3, np.where(d < 128, 4, 0))))
    step = np.where(width == 1, a, np.where(width == 2, (a & 127) << 7 | b, np.where(width == 3, (a & 127) << 14 | (b & 127) << 7 | c, (a & 127) << 21 | (b & 127) << 14 | (c & 127) << 7 | d)))
    where = np.arange(size) + width
    status = raw[where]
    data = np.where((status >> 4 == 0xC) | (status >> 4 == 0xD), 1, 2)
    known = (width > 0) & (status >= 0x80) & (status < 0xF0)
    after = np.where(known, where + 1 + data, -1).tolist()
    steps, places = step.tolist(), where.tolist()
    made, at, tick = [], 0, 0
    add, kinds, bodies = made.append, status.tolist(), body[begin:]
    n = first
    while at < size:
        place, then, kind = places[at], after[at], kinds[at]
        tick += steps[at]
        if then >= 0:
            if then > size:
                return None
            add((tick, track, n, "midi", kind, bodies[place + 1 : then]))
        elif kind == 0xFF and place + 2 < size and bodies[place + 2] < 128:
            then = place + 3 + bodies[place + 2]
            if then > size:
                return None
            add((tick, track, n, "meta", bodies[place + 1], bodies[place + 3 : then]))
            if bodies[place + 1] == 0x2F:
                break
        else:
            return None
        n += 1
        at = then
    return made


def parse(raw: bytes) -> Song:
    """Read a file. Tempos of all tracks hold for all."""
    if raw[:4] != b"MThd" or len(raw) < 14:
        raise ReadError("no standard MIDI file")
    size, _, tracks, division = struct.unpack_from(">IHHH", raw, 4)
    if division & 0x8000 or not division:
        raise ReadError("times in film frames are not read here")
    at, events = 8 + size, []
    for track in range(tracks):
        if raw[at : at + 4] != b"MTrk":
            raise ReadError("a MIDI track is missing")
        end = at + 8 + struct.unpack_from(">I", raw, at + 4)[0]
        if end > len(raw):
            raise ReadError("a MIDI track is cut short")
        body, at, tick, status = raw[:end], at + 8, 0, 0
        if (plain := _plain(body, at, track, len(events))) is not None:
            events += plain
            at = end
            continue
        while at < end:
            step, at = _number(body, at)
            tick += step
            if body[at] & 128:
                status = body[at]
                at += 1
            if status == 0xFF:
                kind = body[at]
                n, at = _number(body, at + 1)
                events.append((tick, track, len(events), "meta", kind, body[at : at + n]))
                at += n
                if kind == 0x2F:
                    break
            elif status in (0xF0, 0xF7):
                n, at = _number(body, at)
                at += n
            elif status >= 0x80:
                n = 1 if status >> 4 in (0xC, 0xD) else 2
                events.append((tick, track, len(events), "midi", status, body[at : at + n]))
                at += n
            else:
                raise ReadError("data without a status in a MIDI track")
        at = end
    song = Song(resolution=division)
    changes = sorted((e[0], e[2], int.from_bytes(e[5], "big")) for e in events if e[3] == "meta" and e[4] == 0x51 and int.from_bytes(e[5], "big"))
    ticks, starts, micros = [0], [0.0], [500_000]
    for tick, _, value in changes:
        starts.append(starts[-1] + (tick - ticks[-1]) * micros[-1] / 1e6 / division)
        ticks.append(tick)
        micros.append(value)
        song.tempos.append((starts[-1], 6e7 / value))

    def seconds(tick: int) -> float:
        k = bisect_right(ticks, tick) - 1
        return starts[k] + (tick - ticks[k]) * micros[k] / 1e6 / division

    found: dict[tuple, Instrument] = {}
    programs: dict[tuple[int, int], int] = {}
    names: dict[int, str] = {}
    sounding: dict[tuple, list] = {}

    def instrument(track: int, channel: int) -> Instrument:
        program = programs.get((track, channel), programs.get((-1, channel), 0))
        return found.setdefault((track, channel, program), Instrument(program, channel == DRUM_CHANNEL, names.get(track, "")))

    for tick, track, _, what, kind, data in events:  # by track and then by tick, as they were read
        if what == "meta":
            if kind == 0x03:
                names[track] = data.decode("latin-1")
            elif kind == 0x58 and len(data) >= 2:
                song.time_signatures.append((seconds(tick), data[0], 1 << data[1]))
            elif kind == 0x59 and len(data) >= 2:
                song.key_signatures.append((seconds(tick), struct.unpack("b", data[:1])[0], bool(data[1])))
            continue
        message, channel = kind >> 4, kind & 15
        if message == 0xC:
            programs[track, channel] = programs[-1, channel] = data[0]
        elif message == 0x9 and data[1]:
            sounding.setdefault((track, channel, data[0]), []).append((seconds(tick), data[1], instrument(track, channel)))
        elif message in (0x8, 0x9):
            if held := sounding.pop((track, channel, data[0]), None):
                now = seconds(tick)
                for onset, velocity, owner in held:
                    if now > onset:
                        owner.notes.append((onset, now, data[0], velocity))
        elif message == 0xB:
            instrument(track, channel).controls.append((seconds(tick), data[0], data[1]))
        elif message == 0xE:
            instrument(track, channel).bends.append((seconds(tick), (data[1] << 7 | data[0]) - 8192))
    song.instruments = list(found.values())
    song.time_signatures.sort()
    song.key_signatures.sort()
    return song


def notes_of(song: Song) -> np.ndarray:
    """All notes in canonical order; instrument is the place of a note's instrument in the song."""
    rows = [(*n[:2], n[2], n[3], i.program, i.is_drum, k) for k, i in enumerate(song.instruments) for n in i.notes]
    return canonical(np.array(rows, NOTE_DTYPE))


def canonical(notes: np.ndarray) -> np.ndarray:
    """Notes by onset, drums last, program, pitch and offset; ties stay in order."""
    return notes[np.lexsort((notes["offset"], notes["pitch"], notes["program"], notes["is_drum"], notes["onset"]))]


def song_of(notes: np.ndarray, resolution: int = 480, tempo: float = 120.0, names: dict[int, str] | None = None) -> Song:
    """A song that plays notes, an instrument for each instrument number, program and kind."""
    song = Song(resolution, [(0.0, tempo)])
    of: dict[tuple[int, int, bool], list[tuple[float, float, int, int]]] = {}
    columns = ("instrument", "program", "is_drum", "onset", "offset", "pitch", "velocity")
    for number, program, is_drum, *note in zip(*(notes[c].tolist() for c in columns), strict=True):
        of.setdefault((number, program, is_drum), []).append(tuple(note))
    for key in sorted(of):
        song.instruments.append(Instrument(key[1], key[2], (names or {}).get(key[0], ""), of[key]))
    return song


def _varied(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(out[::-1])


_SHORT = [_varied(k) for k in range(128)]


def write(song: Song) -> bytes:
    """A file of format 1: a track of tempos and signatures, and one of each instrument."""
    tempos = sorted(song.tempos) or [(0.0, 120.0)]
    if tempos[0][0] > 0:
        tempos.insert(0, (0.0, 120.0))
    starts, beats = [0.0], [0.0]
    for (a, bpm), (b, _) in zip(tempos, tempos[1:], strict=False):
        starts.append(b)
        beats.append(beats[-1] + (b - a) * bpm / 60)

    def tick(time: float) -> int:
        k = max(0, bisect_right(starts, time) - 1)
        return round((beats[k] + (time - starts[k]) * tempos[k][1] / 60) * song.resolution)

    def ticks(times: list[float]) -> list[int]:
        found = np.array(times, float)
        k = np.maximum(np.searchsorted(starts, found, side="right") - 1, 0)
        return np.rint((np.array(beats)[k] + (found - np.array(starts)[k]) * np.array([bpm for _, bpm in tempos])[k] / 60) * song.resolution).astype(np.int64).tolist()

    def track(events: list[tuple[int, int, bytes]]) -> bytes:
        out, now = [], 0
        events.sort(key=itemgetter(0, 1))
        for at, _, body in events:
            step = at - now
            out.append((_SHORT[step] if step < 128 else _varied(step)) + body)
            now = at
        out.append(b"\0\xff\x2f\0")
        body = b"".join(out)
        return b"MTrk" + struct.pack(">I", len(body)) + body

    head = [(tick(t), 0, b"\xff\x51\x03" + round(6e7 / bpm).to_bytes(3, "big")) for t, bpm in tempos]
    head += [(tick(t), 1, bytes([0xFF, 0x58, 4, n, d.bit_length() - 1, 24, 8])) for t, n, d in song.time_signatures]
    head += [(tick(t), 1, b"\xff\x59\x02" + struct.pack("bB", sharps, minor)) for t, sharps, minor in song.key_signatures]
    tracks = [track(head)]
    free = [c for c in range(16) if c != DRUM_CHANNEL]
    for k, i in enumerate(song.instruments):
        channel = DRUM_CHANNEL if i.is_drum else free[k % len(free)]
        events = [(0, 0, b"\xff\x03" + _varied(len(i.name.encode("latin-1", "replace"))) + i.name.encode("latin-1", "replace"))] if i.name else []
        events.append((0, 1, bytes([0xC0 | channel, i.program])))
        events += [(tick(t), 3, bytes([0xB0 | channel, n, v])) for t, n, v in i.controls]
        events += [(tick(t), 3, bytes([0xE0 | channel, v + 8192 & 127, v + 8192 >> 7])) for t, v in i.bends]
        for on, off, (_, _, pitch, velocity) in zip(ticks([n[0] for n in i.notes]), ticks([n[1] for n in i.notes]), i.notes, strict=True):
            events.append((on, 4, bytes((0x90 | channel, pitch, velocity))))
            events.append((off if off > on else on + 1, 2, bytes((0x80 | channel, pitch, 64))))
        tracks.append(track(events))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), song.resolution) + b"".join(tracks)


def tempo_at(song: Song, time: float) -> float:
    """The tempo in effect; 120 before the first one."""
    before = [bpm for t, bpm in song.tempos if t <= time]
    return before[-1] if before else 120.0


def sliced(song: Song, start: float, end: float, include_partial: bool = True) -> Song:
    """What sounds in [start, end), from time 0; controls and bends in effect at the start are carried in."""
    if start < 0 or end < start:
        raise ValueError(f"no such window: [{start}, {end})")
    made = Song(song.resolution, [(0.0, tempo_at(song, start))] + [(t - start, b) for t, b in song.tempos if start < t < end])
    made.time_signatures = [(t - start, *rest) for t, *rest in song.time_signatures if start <= t < end]
    made.key_signatures = [(t - start, *rest) for t, *rest in song.key_signatures if start <= t < end]
    for i in song.instruments:
        own = Instrument(i.program, i.is_drum, i.name)
        for onset, offset, pitch, velocity in i.notes:
            if offset > start and onset < end and (include_partial or onset >= start):
                own.notes.append((max(onset, start) - start, min(offset, end) - start, pitch, velocity))
        held = {n: v for t, n, v in sorted(i.controls, key=lambda c: c[0]) if t < start}
        own.controls = [(0.0, n, held[n]) for n in sorted(held)] + [(t - start, n, v) for t, n, v in sorted(i.controls, key=lambda c: c[0]) if start <= t < end]
        bent = [v for t, v in sorted(i.bends, key=lambda b: b[0]) if t < start]
        own.bends = ([(0.0, bent[-1])] if bent and bent[-1] else []) + [(t - start, v) for t, v in i.bends if start <= t < end]
        made.instruments.append(own)
    return made


def summary(song: Song) -> dict:
    """The metadata of a song's index row."""
    notes = notes_of(song)
    return {
        "duration": song.end, "n_notes": len(notes), "n_instruments": len(song.instruments), "programs": sorted({i.program for i in song.instruments if not i.is_drum}),
        "has_drums": any(i.is_drum for i in song.instruments), "resolution": song.resolution,
        "min_pitch": int(notes["pitch"].min()) if len(notes) else None, "max_pitch": int(notes["pitch"].max()) if len(notes) else None,
    }


def synthesised(song: Song, sample_rate: int = 44100, channels: int = 1, duration: float | None = None, tail: float = 0.0, normalise: bool = False) -> np.ndarray:
    """Sines of all melodic notes as float32 (frames, channels); drums are silent."""
    if channels not in (1, 2):
        raise ValueError("channels must be 1 or 2")
    n = round((duration if duration is not None else song.end + tail) * sample_rate)
    out = np.zeros(n)
    for i in song.instruments:
        for onset, offset, pitch, velocity in () if i.is_drum else i.notes:
            a, b = max(0, round(onset * sample_rate)), min(n, round(offset * sample_rate))
            if b > a:
                t = np.arange(b - a) / sample_rate
                fade = np.minimum(1, np.minimum(np.arange(1, b - a + 1), np.arange(b - a, 0, -1)) / (0.005 * sample_rate))
                out[a:b] += velocity / 127 * 0.2 * fade * np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * t)
    if normalise and n and np.abs(out).max() > 0:
        out /= np.abs(out).max()
    return np.repeat(out.astype(np.float32)[:, None], channels, 1)
