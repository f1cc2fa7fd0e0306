"""Table schemas of the catalogue. Heavy arrays live in their own tables, so a
listing never reads them; automatic and manual values are separate columns."""

from __future__ import annotations

from dataclasses import dataclass

ANALYSIS_VERSION = 3

ANCHOR = "struct<time_sec:double,beat_index:int,bpm:double>"
GRID = (f"struct<anchors:array<{ANCHOR}>,beats_per_bar:int,first_downbeat_sec:double,"
        "is_fixed:boolean,grid_confidence:double,downbeat_confidence:double>")
CUE = "struct<id:string,name:string,time_sec:double>"
TAGS = ("struct<title:string,artist:string,album:string,album_artist:string,genre:string,"
        "year:int,track_number:int,tagged_bpm:double,tagged_key:string,comment:string,"
        "codec:string,bitrate_kbps:int,sample_rate:int,channels:int,lossless:boolean>")
ANALYSIS = ("struct<tempo:struct<bpm:double,confidence:double>,"
            f"grid:{GRID},"
            "key:struct<tonic:int,mode:string,confidence:double,relative_ambiguous:boolean>,"
            "energy:struct<level:int,raw_score:double,confidence:double>,"
            "loudness:struct<integrated_lufs:double>,"
            "hpss:struct<percussive_ratio:double>,"
            "phrases:struct<confidence:double>,"
            "vocal_coverage:double,"
            "structure:struct<sections:array<struct<label:string>>>>")

TRACKS = (
    "id bigint,name string,content_hash string,audio_hash string,relative_path string,"
    "file_path string,mime_type string,size_bytes bigint,duration_sec double,added_at bigint,"
    f"tags {TAGS},analysis {ANALYSIS},analysis_version int,analysis_error string,"
    f"manual_bpm double,manual_grid {GRID},manual_key_tonic int,manual_key_mode string,"
    f"reviewed_at bigint,grid_locked boolean,cues array<{CUE}>,has_fingerprint boolean")

FRAMES = ("track_id bigint,frame bigint,mags array<double>")
PCM = (
    "track_id bigint,channel int,chunk bigint,start_sample bigint,samples array<double>")
JOB_EVENTS = (
    "event_id bigint,job_id bigint,run_id bigint,at timestamp,status string,error_code string")
PROVENANCE = (
    "track_id bigint,analyzer string,version string,params_hash string")


@dataclass(frozen=True)
class FrameGeometry:
    """How a frame table was made: bin b is at b * sample_rate / fft_size Hz."""

    sample_rate: int = 22050
    fft_size: int = 1024
    hop_size: int = 256

    @property
    def frame_rate(self) -> float:
        return self.sample_rate / self.hop_size

    @property
    def bins(self) -> int:
        return self.fft_size // 2 + 1

    def hz(self, b: int) -> float:
        return b * self.sample_rate / self.fft_size
