"""Value domains and schemas of trace records."""

from __future__ import annotations

# Categories of I/O functions.
READ, WRITE, METADATA, PCTL, IPC, OTHER, SYNC = 1, 2, 3, 4, 5, 6, 7

# The functions of each category; any other function is OTHER.
IO_FUNCTIONS = {
    READ: "fread pread pread64 preadv preadv64 read readv".split(),
    WRITE: "fwrite pwrite pwrite64 pwritev pwritev64 write writev".split(),
    SYNC: "fsync fdatasync msync sync".split(),
    METADATA: (
        "__fxstat __fxstat64 __lxstat __lxstat64 __xstat __xstat64 access close closedir fclose fcntl fopen fopen64 fseek fseeko fseeko64 "
        "fstat fstat64 fstatat fstatat64 ftell ftello ftello64 ftruncate ftruncate64 link lseek lseek64 mkdir open open64 opendir readdir "
        "readdir64 readlink remove rename rmdir seek stat stat64 unlink"
    ).split(),
    PCTL: "exec exit fork kill pipe wait".split(),
    IPC: "msgctl msgget msgrcv msgsnd semctl semget semop shmat shmctl shmdt shmget".split(),
}

# Upper edges of the size bins in bytes, and the bins' names.
SIZE_EDGES = [4 << 10, 16 << 10, 64 << 10, 256 << 10, 1 << 20, 4 << 20, 16 << 20, 64 << 20, 256 << 20, 1 << 30, 4 << 30]
SIZE_BINS = [
    "0_4kib", "4kib_16kib", "16kib_64kib", "64kib_256kib", "256kib_1mib", "1mib_4mib",
    "4mib_16mib", "16mib_64mib", "64mib_256mib", "256mib_1gib", "1gib_4gib", "4gib_plus",
]

# Events on these paths and of these functions are left out (the last list holds regular expressions).
IGNORED_PATHS = ["/dev/", "/etc/", "/gapps/python", "/lib/python", "/proc/", "/software/", "/sys/", "/usr/lib", "/usr/tce/backend", "/usr/tce/packages", "/venv", "__pycache__"]
IGNORED_FUNCTIONS = ["DLIOBenchmark.__init__", "DLIOBenchmark.initialize", "FileStorage.__init__", "TorchDataset.__init__"]
IGNORED_FUNCTION_PATTERNS = [
    "Checkpointing.__init__", "Checkpointing.finalize", "Checkpointing.get_tensor", "DataLoader.__init__", "DataLoader.finalize", "DataLoader.get_tensor",
    "DataLoader.next", "Framework.get_loader", "Framework.init_loader", "Framework.is_nativeio_available", "Framework.trace_object", "Reader.__init__",
    "Reader.load_index", "Reader.next", "Reader.read_index", ".save_state", "checkpoint_end_", "checkpoint_start_",
]

# What a path adds to the category of a posix or stdio event.
PATH_SUFFIXES = [("/data", "_reader"), ("/checkpoint", "_checkpoint"), ("/lustre", "_lustre"), ("/ssd", "_ssd")]

# Names of views, and of columns and args of the trace format.
VIEW_TYPES = ["file_name", "proc_name", "time_range"]
TEMPORAL_VIEWS = ["window", "epoch", "step", "time_range"]

#: Microseconds per second.
TICKS = 1_000_000

TRACE_COLUMNS = {
    "cat": "string", "func_name": "string", "pid": "bigint", "tid": "bigint", "epoch": "bigint", "step": "bigint", "file_hash": "string", "host_hash": "string",
    "file_name": "string", "host_name": "string", "proc_name": "string", "io_cat": "tinyint", "acc_pat": "tinyint", "count": "bigint", "time": "bigint",
    "size": "bigint", "offset": "bigint", "time_start": "bigint", "time_end": "bigint", "time_range": "bigint",
}
PROFILE_IDENTITY = ["cat", "func_name", "pid", "tid", "epoch", "step", "file_hash", "host_hash", "file_name", "host_name", "proc_name", "io_cat", "acc_pat", "time_range", "time_start", "time_end"]
PROFILE_STATS = ["time_min", "time_max", "size_min", "size_max", "offset_min", "offset_max"]

_ARGS = {
    "string": "hhash fhash name value",
    "bigint": (
        "ret offset flags whence image_id epoch step dft_cnt dur dur_sum dur_min dur_max ret_sum ret_min ret_max offset_sum offset_min offset_max "
        "count count_sum count_min count_max"
    ),
    "double": "user_pct system_pct iowait_pct idle_pct irq_pct softirq_pct MemAvailable MemFree Cached Dirty Active",
}


def raw_schema(extra: str = "") -> str:
    """The schema of one raw record; extra: further fields of args, as DDL."""
    fields = ", ".join([f"{n}: {t}" for t, names in _ARGS.items() for n in names.split()] + ([extra] if extra else []))
    return f"id bigint, name string, cat string, pid bigint, tid bigint, ph string, ts bigint, dur bigint, args struct<{fields}>"
