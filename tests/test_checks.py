import pytest

from colloquy.operators import schedule


@pytest.mark.parametrize("minutes, good", [(0, False), (1, True), (1440, True), (1441, False), (-5, False)])
def test_overrides_last_a_minute_to_a_day(minutes, good):
    if good:
        assert schedule.checked_override(minutes) == minutes
    else:
        with pytest.raises(ValueError):
            schedule.checked_override(minutes)


@pytest.mark.parametrize("days, good", [(7, True), (6, False), (8, False)])
def test_a_schedule_has_seven_days(days, good):
    week = [{"start_min": 0, "end_min": 1440}] * days
    if good:
        assert schedule.checked_days(week) == week
        for edge in ({"start_min": -1, "end_min": 5}, {"start_min": 0, "end_min": 1441}):
            with pytest.raises(ValueError):
                schedule.checked_days([*week[:6], edge])
    else:
        with pytest.raises(ValueError):
            schedule.checked_days(week)
