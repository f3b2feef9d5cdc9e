"""All that reads and writes Kaldi files, under one name: DataFrames, local readers and writers, objects, names and matrices."""

from .errors import ReadError
from .functions.codecs.kaldi_obj import read_object, slice_segment, write_object
from .functions.codecs.kaldi_quant import compress, data_size, decompress, header
from .functions.specifier import parse_extended_filename, parse_rspecifier, parse_specifier, parse_wspecifier
from .sources.kaldi import decoded, fetch, last_of_each, load_ark, load_object, opened, opened_to_write, quantised, read, read_scp, read_segments, register, save_ark, save_object, segment_arrays, slice_segments, write
from .sources.kaldi_files import Reader, Scp, Segments, Writer, scp_lines, segment_lines

#: A list of sound files is an scp like any other.
read_wav_scp = read_scp
WavScp = Scp

__all__ = [
    "ReadError", "Reader", "Scp", "Segments", "WavScp", "Writer", "compress", "data_size", "decoded", "decompress", "fetch", "header", "last_of_each", "load_ark", "load_object", "opened", "opened_to_write",
    "parse_extended_filename", "parse_rspecifier", "parse_specifier", "parse_wspecifier", "quantised", "read", "read_object", "read_scp", "read_segments", "read_wav_scp", "register", "save_ark", "save_object",
    "scp_lines", "segment_arrays", "segment_lines", "slice_segment", "slice_segments", "write", "write_object",
]
