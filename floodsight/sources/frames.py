"""Raw Ethernet frames to packets, with built-in functions only."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from floodsight.operators.generated import own_method
from floodsight.schemas import FRAMES, PACKETS

# Fixed values of the wire formats: byte offsets from 0, sizes, and flag bits of the TCP header.
ETHERTYPE_IPV4 = 0x0800
ETHERNET_BYTES = 14
IPV4_BYTES = 20
L4_BYTES = {6: 20, 17: 8, 1: 4}
# Wire bit of each flag, in our bit order: URG, ACK, PSH, RST, SYN, FIN.
TCP_WIRE_BITS = [0x20, 0x10, 0x08, 0x04, 0x02, 0x01]


def _uint(at, size: int) -> Column:
    """Big-endian unsigned number of `size` bytes (7 at most) at a byte offset of `frame`."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring("frame", start, F.lit(size))), 16, 10).cast("bigint")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Every frame with its packet columns and `reject`: NULL, or why it is no packet for the rules.

    `proto` is set for every IPv4 frame. `frame_len` is the whole frame. Fragments and tags are
    not looked at: ports are read where the IP header ends.
    """
    size = F.octet_length("frame")
    # EtherType, version and header length side by side: one conversion for all of them.
    head = F.when(size >= ETHERNET_BYTES + IPV4_BYTES, _uint(12, 3))
    df = own_method(frames, {"_head": head, "_size": size})
    is_ip = F.shiftright("_head", 8) == ETHERTYPE_IPV4
    header = (ETHERNET_BYTES + F.col("_head").bitwiseAND(F.lit(15)) * 4).cast("int")
    df = own_method(df, {"proto": F.when(is_ip, _uint(23, 1)).cast("int"), "_l4": header})
    l4_size = F.when(F.col("proto") == 6, L4_BYTES[6]).when(F.col("proto") == 17, L4_BYTES[17])
    l4_size = l4_size.when(F.col("proto") == 1, L4_BYTES[1])
    reject = (
        F.when(F.col("_head").isNull(), F.lit("short frame"))
        .when(F.col("proto").isNull(), F.lit("not IPv4"))
        .when(l4_size.isNull(), F.lit("other protocol"))
        .when(F.col("_size") < F.col("_l4") + l4_size, F.lit("short frame"))
    )
    df = own_method(df, {"reject": reject})
    good = F.col("reject").isNull()
    tcp, udp, icmp = (good & (F.col("proto") == number) for number in (6, 17, 1))
    l4 = F.col("_l4")
    df = own_method(
        df,
        {
            "src_ip": F.when(good, _uint(26, 4)),
            "dst_ip": F.when(good, _uint(30, 4)),
            "_ports": F.when(tcp | udp, _uint(l4, 4)),
            # The first bytes that mean something else in each protocol.
            "_rest": F.when(tcp, _uint(l4 + 12, 4)).when(udp, _uint(l4 + 4, 2)).when(icmp, _uint(l4, 2)),
        },
    )
    df = own_method(df, {"seq": F.when(tcp, _uint(l4 + 4, 4)), "ack": F.when(tcp, _uint(l4 + 8, 4))})
    rest = F.col("_rest")
    wire = F.shiftright("_rest", 16)
    flags = F.lit(0).cast("bigint")
    for position, bit in enumerate(TCP_WIRE_BITS):
        flags = flags + F.when(wire.bitwiseAND(F.lit(bit)) != 0, F.lit(1 << position)).otherwise(F.lit(0))
    df = own_method(
        df,
        {
            "sport": F.shiftright("_ports", 16).cast("int"),
            "dport": F.col("_ports").bitwiseAND(F.lit(65535)).cast("int"),
            "win": F.when(tcp, rest.bitwiseAND(F.lit(65535))).cast("int"),
            "tcp_hlen": F.when(tcp, F.shiftright("_rest", 28) * 4).cast("int"),
            "tcp_flags": F.when(tcp, flags).cast("int"),
            "udp_len": F.when(udp, rest).cast("int"),
            "icmp_type": F.when(icmp, F.shiftright("_rest", 8)).cast("int"),
            "icmp_code": F.when(icmp, rest.bitwiseAND(F.lit(255))).cast("int"),
        },
    )
    return df.withColumn("frame_len", F.col("frame_len").cast("bigint")).drop(
        "_head", "_size", "_l4", "_ports", "_rest"
    )


# Why a frame is no packet for the rules.
REJECTS = ["short frame", "not IPv4", "other protocol"]


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A table of frames (schema FRAMES) with a `pkt_id` from file and row, the same at every reading."""
    return _with_row_ids(spark.read.schema(FRAMES).parquet(path))


def stream_frames(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FRAMES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _with_row_ids(reader.parquet(path))


def _with_row_ids(frames: DataFrame) -> DataFrame:
    """31 bits of the file's name, 32 bits for the row: rows of a file keep their order."""
    file = F.xxhash64("_metadata.file_name").bitwiseAND(F.lit(2**31 - 1))
    return frames.select(*FRAMES.fieldNames(), (F.shiftleft(file, 32) + F.col("_metadata.row_index")).alias("pkt_id"))


def frame_packets(frames: DataFrame, observe: Observation | str | None = None) -> DataFrame:
    """The packets of `frames`; `pkt_id` is kept when the frames have one.

    With `observe` (an Observation, or a name where `frames` is a stream) the job counts `frames`, and the rejected ones by
    reason as `short_frame`, `not_IPv4` and `other_protocol`, on the way.
    """
    decoded = decode_frames(frames)
    if observe is not None:
        rejected = [F.count_if(F.col("reject") == reason).alias(reason.replace(" ", "_")) for reason in REJECTS]
        decoded = decoded.observe(observe, F.count(F.lit(1)).alias("frames"), *rejected)
    decoded = decoded.filter("reject IS NULL")
    names = [f.name for f in PACKETS.fields if f.name in decoded.columns]
    return decoded.select(*names)


def frame_rejects(frames: DataFrame) -> DataFrame:
    """Counts of frames that are no packet, by source and reason."""
    rejected = decode_frames(frames).filter("reject IS NOT NULL")
    return rejected.groupBy("source_id", "reject").agg(F.count(F.lit(1)).alias("frames"))
