"""A subscriber that executors can import."""

import time


def slow(options):
    """Takes its time, and writes what it gets to a file."""

    def put(value):
        time.sleep(0.0 if "counts" in value else 0.2)
        with open(options["said"], "a") as f:
            f.write(value + "\n")

    return put
