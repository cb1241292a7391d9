from covermetrics.functions import dates, masking, numbers, strings  # noqa: F401
