"""From tables of events or measurements to regular multichannel series, and between layouts.

Long: series_id, t, channel, value.  Wide: series_id, t and a column per
channel.  Dense: series_id, t, x ARRAY<DOUBLE>.  t counts grid steps.
"""

from .series import from_channel_major, regularise, require_complete, to_channel_major, to_dense, to_long, to_wide  # noqa: F401
